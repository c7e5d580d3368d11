"""Rule settings and their defaults; a YAML or JSON-like dict can override any of them."""

from __future__ import annotations

import copy
from typing import Any

#: The rules that decide results.
DEFAULTS: dict[str, Any] = {
    "path_rules": [("**/security/**", "RESTRICTED"), ("**/credentials/**", "RESTRICTED"), ("**/secrets/**", "RESTRICTED"), ("**/public/**", "PUBLIC")],
    "restricted_extensions": [".rego", ".pem", ".key", ".crt", ".env"],
    "pii_patterns": {
        "aws_key": r"AKIA[0-9A-Z]{16}",
        "jwt": r"eyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_.+/=]+",
        "credit_card": r"\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b",
        "korean_ssn": r"\b[0-9]{6}-[1-4][0-9]{6}\b",
    },
    "chunk_tokens": {"ko": 1100, "other": 700},
    "overlap_ratio": 0.15,
    "top_k": 20,
    "rrf_k": 60,
    "triggers": {
        "CALLS": ["호출한다", "호출하는", "요청한다", "요청하는", "연동", "통신", "calls", "invokes", "requests", "connects to"],
        "PUBLISHES": ["발행한다", "발행하는", "전송한다", "보낸다", "publish", "publishes", "emits", "sends", "produces"],
        "SUBSCRIBES": ["구독한다", "구독하는", "수신한다", "받는다", "consume", "subscribes", "consumes", "listens", "receives"],
    },
    "negations": ["않는다", "않는", "않음", "않고", "하지 않", "안 하", "does not", "doesn't", "do not", "don't", "not "],
    "graph_keywords": ["의존성", "호출", "관계", "연결", "통신", "아키텍처", "토폴로지", "서비스 맵", "dependency", "call", "relation", "connect", "topology", "architecture"],
    "diff_keywords": ["diff", "불일치", "차이", "shadow", "관측", "실제"],
    "doc_types": [(("api", "contract"), "api_spec"), (("pipeline", "spec"), "spec"), (("design", "architecture"), "design_doc"), (("policy", "security"), "policy"), (("config",), "config")],
    "lookback_minutes": 60,
    "window_minutes": 5,
}


def load(override: dict[str, Any] | None = None) -> dict[str, Any]:
    return copy.deepcopy(DEFAULTS) | (override or {})


def load_yaml(path: str) -> dict[str, Any]:
    """A settings or gazetteer file; {} where it does not exist.  Needs a YAML parser installed."""
    import os

    if not os.path.exists(path):
        return {}
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
