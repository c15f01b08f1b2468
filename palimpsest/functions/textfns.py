"""Text functions as columns: normalising, privacy patterns, URLs, cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind, severity and pattern of sensitive text, in the order in which they are masked (fixed values).
PRIVACY_PATTERNS = [
    ("api_key", "high", r"(?i)(?:sk-[A-Za-z0-9_-]{16,}|(?:api[_ -]?key|token|secret)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{12,})"),
    ("private_key", "high", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("password", "high", r"(?i)(?:password|passwd|密码)\s*[:=：]\s*\S{4,}"),
    ("cn_identity_number", "high", r"(?<!\d)\d{17}[0-9Xx](?!\d)"),
    ("bank_card", "high", r"(?<!\d)(?:\d[ -]?){15,19}(?!\d)"),
    ("phone_number", "medium", r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)"),
    ("email", "medium", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("bearer_token", "high", r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}"),
    ("credential_pair", "high", r"\b[0-9a-f]{32}\.[A-Za-z0-9_-]{8,32}\b"),
    ("cloud_api_token", "high", r"\b(?:ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16})\b"),
]
#: Query keys that only track (fixed values).
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
#: The same of captured pages, besides all that begin with utm_ (fixed values).
CAPTURE_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "share_source", "share_token"]


def _java(pattern: str) -> str:
    """A pattern for Java with Unicode classes; blanks are those of the patterns' own engine, which has four separators more."""
    blank = r"\s\x1c-\x1f"
    text = pattern.replace(r"\s", f"[{blank}]").replace(r"\S", f"[^{blank}]")
    return "(?U)" + text


def collapse(c: Column) -> Column:
    """Blanks of any kind as one; no-break and ideographic blanks too."""
    return F.trim(F.regexp_replace(c, _java(r"\s+"), " "))


def normalise_content(c: Column) -> Column:
    """Lower case, signs to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(normalise_content(c).cast("binary"), 256)


def letters_only(c: Column) -> Column:
    """Lower case without anything but word characters."""
    return F.regexp_replace(F.lower(c), r"(?U)[^\w]+", "")


def privacy_counts(c: Column) -> dict[str, Column]:
    """Hits of each kind of sensitive text, on the unmasked text."""
    return {kind: F.regexp_count(c, F.lit(_java(pattern))) for kind, _, pattern in PRIVACY_PATTERNS}


def privacy_hits(c: Column, severity: str | None = None) -> Column:
    """Whether any pattern (of a severity) is found; each stops at its first hit."""
    hit = F.lit(False)
    for _, s, p in PRIVACY_PATTERNS:
        hit = hit | c.rlike(_java(p)) if severity in (None, s) else hit
    return F.coalesce(hit, F.lit(False))


def privacy_class(c: Column) -> Column:
    """restricted if there is any hit of high severity, else private."""
    return F.when(privacy_hits(c, "high"), "restricted").otherwise("private")


def redact(c: Column) -> Column:
    """Masks the patterns one after another: an earlier mask can hide a later hit. Null gives the empty text."""
    for kind, _, pattern in PRIVACY_PATTERNS:
        c = F.regexp_replace(c, _java(pattern), f"[REDACTED:{kind}]")
    return F.coalesce(c, F.lit(""))


def _decoded(c: Column) -> Column:
    """A form value: plus signs are blanks, percent signs with two hexadecimal digits are bytes of UTF-8, others stay."""
    safe = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(safe)


def _encoded(c: Column) -> Column:
    """A form value again; unlike the JVM's encoder, '~' stays and '*' does not."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _pairs(query: Column) -> Column:
    """(k, v) of each part of a query, decoded; a part without a sign has an empty value."""
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")
    cut = lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(value(p)).alias("v"))
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), cut)


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p.k), F.lit("="), _encoded(p.v))), "&")


def clean_url(c: Column) -> Column:
    """A captured page's URL without fragment and tracking keys; order, host and path stay as they are written."""
    url = F.trim(F.regexp_replace(c, r"[\t\r\n]", ""))
    front, query = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    left = _joined(F.filter(_pairs(query), lambda p: ~F.lower(p.k).isin(CAPTURE_KEYS) & ~F.startswith(F.lower(p.k), F.lit("utm_"))))
    return F.concat(front, F.when(left == "", "").otherwise(F.concat(F.lit("?"), left)))


def _netloc_parts(c: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(scheme, host, port, path, query) of a URL by the generic grammar, which unlike java.net.URI admits any character."""
    part = lambda n: F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$", n)
    host = F.regexp_replace(part(2), r"^[^@]*@", "")
    bare = F.regexp_extract(host, r"^(\[[^\]]*\]|[^:]*)(?::(\d*))?$", 1)
    return F.lower(part(1)), F.lower(F.translate(bare, "[]", "")), F.regexp_extract(host, r"^(?:\[[^\]]*\]|[^:]*)(?::(\d*))?$", 1), part(3), part(4)


def normalise_url(c: Column) -> Column:
    """Scheme and host in lower case, no fragment, default ports or tracking keys, no last slash; '' if not http(s).

    The query is decoded, sorted by key and value and encoded again; keys without a value keep an empty one.
    """
    scheme, host, port, path, query = _netloc_parts(F.trim(F.regexp_replace(c, r"[\t\r\n]", "")))
    bare = F.regexp_replace(path, r"/+$", "")
    joined = _joined(F.array_sort(F.filter(_pairs(query), lambda p: ~F.lower(p.k).isin(TRACKING_KEYS))))
    number = F.when(port != "", port.cast("int"))
    shown = F.when(number.isNotNull() & ~number.isin(0, 80, 443), F.concat(F.lit(":"), number.cast("string"))).otherwise("")
    out = F.concat(scheme, F.lit("://"), host, shown, F.when(bare == "", "/").otherwise(bare), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    return F.when(scheme.isin("http", "https") & (host != ""), out).otherwise("")


def occurrences(c: Column, term: str, lowered: bool = False) -> Column:
    """Overlapping occurrences of a term, without regard to case. Only a term that can overlap itself needs a pattern."""
    low, t = c if lowered else F.lower(c), term.lower()
    if any(t[:n] == t[-n:] for n in range(1, len(t))):
        return F.regexp_count(low, F.lit(rf"(?=\Q{t}\E)"))
    return ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int")


def preview(c: Column, n: int = 200) -> Column:
    """Line breaks as blanks, first characters."""
    return F.substring(F.translate(c, "\n", " "), 1, n)


def snippet(c: Column, n: int = 120) -> Column:
    """At most n characters; a cut one ends with an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def query_terms(c: Column) -> Column:
    """Distinct words of two characters and more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w{2,})"), 1))


def failure_reason(c: Column) -> Column:
    """Failure texts that differ in numbers or blanks only become one."""
    text = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), _java(r"\b\d+\b"), " "), _java(r"\s+"), " ")))
    return F.when(text == "", "unknown failure").otherwise(text)


def failure_key(source: Column, stage: Column, reason: Column) -> Column:
    parts = [F.coalesce(x, F.lit("")) for x in (source, stage, reason)]
    return F.substring(F.sha2(F.concat_ws("\x00", *parts).cast("binary"), 256), 1, 16)


def completeness(text: Column, transcript: Column, html: Column) -> Column:
    """How much of a page was captured: both texts, one of a readable length, something, or nothing but its address."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(full(transcript) & full(text), "full").when(full(transcript) | (F.length(F.coalesce(text, F.lit(""))) >= 500), "content").when(full(html) | full(text), "partial").otherwise("metadata_only")
