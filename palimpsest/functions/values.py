"""Values given loosely: JSON, lists, flags, numbers, instants, names; as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONED = r"(Z|[+-]\d{2}:?\d{2})$"
#: Texts that mean yes (fixed values).
YES = ["1", "true", "yes", "on"]
#: Characters that file names cannot hold (fixed value).
_NO_NAME = r"[<>:\"/\\|?*\x00-\x1f]"


def as_list(c: Column) -> Column:
    """A JSON array's items as texts; any other text is a list of itself; null and '' are empty."""
    listed = F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>"))
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(c)))


def as_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(YES), F.lit(False))


def as_number(c: Column, default: float = 1.0) -> Column:
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(default))


def json_or(c: Column, schema: str, default: Column) -> Column:
    """The parsed value; the default where there is none or it cannot be parsed."""
    return F.when(c.isNull() | (c == ""), default).otherwise(F.coalesce(F.from_json(c, schema), default))


def canonical_json(pairs: Column) -> Column:
    """A map as JSON with its keys in order, so that equal maps are equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def request_key(kind: Column, parts: Column, tags: Column, weight: Column) -> Column:
    """A digest of a request: keys in a fixed order, a set's items sorted and distinct; null where a number is not finite."""
    text = F.to_json(F.struct(kind.alias("kind"), parts.alias("parts"), F.array_sort(F.array_distinct(tags)).alias("tags"), weight.alias("weight")))
    finite = ~F.isnan(weight) & (F.abs(weight) < F.lit(float("inf")))
    return F.when(finite, F.sha2(text.cast("binary"), 256))


def lenient_instant(c: Column) -> Column:
    """The instant of an ISO text; one without a zone is read as UTC, unlike strict_instant."""
    text = F.trim(c)
    return F.when(text.rlike(_ZONED), F.try_to_timestamp(text)).otherwise(F.try_to_timestamp(F.concat(text, F.lit("Z"))))


def iso_second(c: Column) -> Column:
    """Epoch seconds or an ISO text as an ISO text of whole seconds; other texts stay, null is empty."""
    shown = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    epoch = c.try_cast("double")
    return F.when(c.isNull() | (c == ""), "").when(epoch.isNotNull(), shown(F.timestamp_seconds(F.floor(epoch)))).otherwise(F.coalesce(shown(lenient_instant(c)), c))


def _last(text: Column, piece: str) -> Column:
    """The place of the last `piece` from 0, -1 where there is none."""
    at = F.instr(F.reverse(text), piece[::-1])
    return F.when(at > 0, F.length(text) - at - len(piece) + 1).otherwise(-1)


def natural_cut(c: Column, budget: Column, stops: tuple[str, ...] = ("。", "\n", ". "), least: int = 20) -> Column:
    """At most about `budget` characters, cut after the last sentence or line in the second half if there is one, with an
    ellipsis; '' for a budget under `least`."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\A\s+|\s+\z", "")
    stop = F.greatest(budget - 1, F.lit(0))
    head = F.left(text, stop)
    places = [_last(head, s) for s in stops]
    last = F.greatest(*places) if len(places) > 1 else places[0]
    at = F.when(last < F.floor(budget / 2), stop).otherwise(last)
    cut = F.concat(F.regexp_replace(F.left(text, at + 1), r"(?U)\s+\z", ""), F.lit("…"))
    return F.when((text == "") | (budget < least), "").when(F.length(text) <= budget, text).otherwise(cut)


def safe_token(c: Column) -> Column:
    """Text fit for a rendered label: other signs become '_', 160 characters at most."""
    return F.left(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9_.:-]", "_"), F.lit(160))


def slug(c: Column, empty: str = "opportunity") -> Column:
    low = F.lower(F.regexp_replace(F.regexp_replace(F.left(c, F.lit(30)), r"(?U)[^\w\x{4e00}-\x{9fff}-]+", "_"), r"^_+|_+$", ""))
    return F.when(F.coalesce(low, F.lit("")) == "", empty).otherwise(low)


def file_name(c: Column, empty: str = "untitled.md") -> Column:
    name = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, _NO_NAME, "_")), r"\.+$", ""), r"(?U)\s+", " ")
    return F.when(F.coalesce(name, F.lit("")) == "", empty).otherwise(name)


def repository(c: Column) -> Column:
    """owner/name of a remote address, written as a URL, as user@host:path or as a path; '' where there is none."""
    text = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/"))
    path = (
        F.when(text.rlike(r"^[^@]+@[^:]+:.+$"), F.regexp_extract(text, r"^[^:]*:([\s\S]*)$", 1))
        .when(F.contains(text, F.lit("://")), F.regexp_extract(text, r"^[^:]*://[^/?#]*([^?#]*)", 1)).otherwise(text)
    )
    bare = F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"\.git$", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise("")


def project_of(repo: Column, prefix: str = "PROJ-") -> Column:
    """The project's identity: the repository's name in capitals, other signs as one dash."""
    name = F.regexp_replace(F.substring_index(repo, "/", -1), r"[^A-Za-z0-9]+", "-")
    return F.concat(F.lit(prefix), F.upper(F.regexp_replace(name, r"^-+|-+$", "")))


def first_heading(c: Column) -> Column:
    return F.regexp_extract(c, r"(?m)^# (.+)$", 1)


def noted(c: Column, labels: list[str]) -> Column:
    """What stands after one of the labels and a colon on its line; null where it is missing, or only says that there is nothing."""
    found = F.trim(F.regexp_extract(c, rf"(?:{'|'.join(labels)})[：:]\s*(.+)", 1))
    return F.when(~found.isin("", "-", "无", "暂无"), found)


def distinct_first(a: Column, b: Column, n: int = 10) -> Column:
    """Distinct items of both lists that are not blank, those of a first, n at most."""
    kept = F.filter(F.transform(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.array_distinct(kept), 1, n)


def holds_either(a: Column, b: Column) -> Column:
    """Whether the longer of two texts contains the shorter."""
    return F.when(F.length(a) >= F.length(b), F.contains(a, b)).otherwise(F.contains(b, a))
