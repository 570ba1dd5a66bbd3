"""Text forms that must agree byte for byte with other programs, as pandas functions where SQL has none."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a diagnostic may hold, the marks of what it may not, and keys that are secret by name or by a part of it.
DEPTH, ITEMS, STRING_BYTES, REDACTED, TRUNCATED = 8, 64, 2048, "[REDACTED]", "[TRUNCATED]"
SECRET_KEYS = frozenset((
    "authorization", "cookie", "set-cookie", "payload", "payload_body", "task_payload", "event_payload", "claim_token", "claim-token",
    "x-queue-claim-token", "credential", "credentials", "secret", "password", "passwd", "token", "access_token", "refresh_token",
    "api_key", "apikey", "database_url", "dsn", "sentry_dsn", "bearer",
))
SECRET_PARTS = ("claim_token", "claim-token", "authorization", "password", "secret", "credential", "payload", "cookie")


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys and no blanks; null where the text is not JSON or holds NaN or infinity."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text, parse_constant=_refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except ValueError:
        return None


def _refuse(name: str) -> None:
    raise ValueError(name)


def canonical_json(column: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(canonical, na_action="ignore"), "string")(column)


def fingerprint(column: Column) -> Column:
    """SHA-256 of a JSON text's canonical form."""
    return F.sha2(canonical_json(column), 256)


def _key(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def _secret(key: str) -> bool:
    return key in SECRET_KEYS or any(part in key for part in SECRET_PARTS)


def sanitise(value: object, allowed: frozenset[str], depth: int = 0) -> object:
    """A JSON value as a diagnostic may show it: values of secret keys are masked, other keys that are not allowed (whatever their case) left out.

    Long strings and what lies deeper than DEPTH become a mark, and so does the rest of a long list.
    """
    if depth > DEPTH:
        return TRUNCATED
    if isinstance(value, dict):
        known = {_key(k) for k in allowed}
        return {k: REDACTED if _secret(_key(k)) else sanitise(v, allowed, depth + 1) for k, v in value.items() if _secret(_key(k)) or _key(k) in known}
    if isinstance(value, list):
        return [sanitise(v, allowed, depth + 1) for v in value[:ITEMS]] + [TRUNCATED] * (len(value) > ITEMS)
    if isinstance(value, str):
        return TRUNCATED if len(value.encode(errors="replace")) > STRING_BYTES else value
    return value


def sanitised_json(column: Column, allowed: frozenset[str]) -> Column:
    def one(text: str) -> str | None:
        try:
            return json.dumps(sanitise(json.loads(text), allowed), sort_keys=True)
        except ValueError:
            return REDACTED

    return F.pandas_udf(lambda s: s.map(one, na_action="ignore"), "string")(column)


def rfc3339(column: Column) -> Column:
    """UTC time to microseconds, with Z."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def without_tokens(labels: Column) -> Column:
    """A map of strings without keys that carry secrets."""
    return F.map_filter(labels, lambda k, v: ~(k.endswith("_token") | k.isin("authorization", "password", "payload", "secret")))


def encode_cursor(fields: dict, key: bytes, most: int = 512) -> str:
    """A keyset cursor that a client can carry but not change."""
    body = json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()
    token = base64.urlsafe_b64encode(hmac.digest(key, body, "sha256") + body).rstrip(b"=").decode()
    if len(token) > most:
        raise ValueError("cursor is too long")
    return token


def decode_cursor(token: str, key: bytes, most: int = 512) -> dict:
    if len(token) > most or not re.fullmatch(r"[A-Za-z0-9_-]+", token):
        raise ValueError("cursor is malformed")
    raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
    if not hmac.compare_digest(raw[:32], hmac.digest(key, raw[32:], "sha256")):
        raise ValueError("cursor is not ours")
    return json.loads(raw[32:])


def confirmation(action: str, filters: dict, at: int, key: bytes) -> str:
    """A token that confirms a previewed bulk action; see confirmed."""
    body = f"{action}\n{json.dumps(filters, sort_keys=True)}\n{at}".encode()
    return f"{at}.{hmac.new(key, body, hashlib.sha256).hexdigest()}"


def confirmed(token: str, action: str, filters: dict, now: int, key: bytes, ttl: int = 300) -> bool:
    at, _, _ = token.partition(".")
    return at.isdigit() and 0 <= now - int(at) <= ttl and hmac.compare_digest(token, confirmation(action, filters, int(at), key))


