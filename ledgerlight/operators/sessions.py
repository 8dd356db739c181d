"""A follow-up's session, signed so that what comes back is what was sent. Small payloads of one session, on the driver."""

from __future__ import annotations

import hashlib
import hmac
import json


def canonical(payload: dict) -> bytes:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def signature(payload: dict, key: bytes) -> str:
    """HMAC-SHA256 of the canonical JSON of a payload, in hex."""
    if len(key) < 16:
        raise ValueError("a key has 16 bytes at least")
    return hmac.new(key, canonical(payload), hashlib.sha256).hexdigest()


def seal(payload: dict, key: bytes) -> dict:
    return {"payload": payload, "signature": signature(payload, key)}


def opened(sealed: dict, key: bytes) -> dict:
    """The payload of a sealed session; a ValueError if it is not what was sealed."""
    payload, said = sealed.get("payload"), sealed.get("signature")
    if not isinstance(payload, dict) or not isinstance(said, str) or not hmac.compare_digest(signature(payload, key), said):
        raise ValueError("the session is not what was sealed")
    return payload
