"""Rules that decide what a row may do: paths, titles, failures, evidence, reviews, cards; as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
EXCLUDED_FOLDERS = [".git", ".obsidian", ".trash", "node_modules", ".venv", "__pycache__"]
EXCLUDED_PREFIXES = ["00-System/Logs", "00-System/Index-Status", "00-System/Backups", "00-System/Context-Packs"]
NOT_ANALYSED = ["00-System", "05-Operations", "08-Private", "09-Archive", "Attachments", "PEMIS"]
PROCESS_LOG = r"(?i)(task\s?\d|审查|终审|验收|修复|核查|复检|问题发现|问题点|报告提交|spec\s?fail|needs[_-]?fixes|codex任务|\.md\b)"
NOTIFICATION_MARKERS = ["失败", "报错", "崩溃", "中断", "超时", "不可用", "无法"]
CONCLUSION_MARKERS = ["完成", "修复", "解决", "已", "结论", "方案", "通过", "确定", "拍板", "修复了"]
FAILURE_MARKERS = ["distinct session_meta", "no supported messages", "exceeds bounded size", "unknown Codex rollout", "symlink"]
DURABLE_TYPES = ["knowledge", "decision", "procedure", "preference", "project_fact"]
EXEMPT_TYPES = ["note", "noise", "transient"]
DESTRUCTIVE = ["delete", "forget", "archive", "remove", "permission_change", "privacy_change"]
UNVERIFIED = ["", "failed", "unverified", "unknown", "cancelled", "partial"]
REPORT_SOURCES = ["codex", "work_report", "development_report"]
HIGH_RISK = ["core", "core_memory", "identity", "credentials", "credential", "secret", "secrets", "permission", "permissions", "medical", "legal", "financial", "security", "destructive", "irreversible", "privacy", "restricted"]
LEAST_CONFIDENCE = 0.90
VALUE_SIGNALS = [
    r"```", r"(?i)https?://", r"(?i)(?:^|\s)(?:[A-Za-z]:\\|/(?:Users|home|etc|var|opt)/)", r"(?:^|\n)\s*\$\s+\S",
    r"(?i)(决定|拍板|结论|方案|确认|部署|上线|发布|修复|排查|报错|bug|错误|完成|交付|验收|迁移|回滚|密码|密钥|token|key|API|decide|decision|conclusion|deploy|release|fix|error|root cause|ship|done|migrate|rollback)",
]
MIN_TURNS, MIN_CHARS = 2, 300
SENSITIVE_KEYS = r"(?i)(password|passwd|secret|token|api[_-]?key|authorization|cookie|private[_-]?key|credential)"
PLATFORMS = [(["mp.weixin.qq.com"], "wechat_article"), (["channels.weixin.qq.com"], "video_channel"), (["douyin.com", "iesdouyin.com"], "douyin"), (["xiaohongshu.com", "xhslink.com"], "xiaohongshu"), (["bilibili.com"], "bilibili"), (["youtube.com"], "youtube")]


def _any(c: Column, texts: list[str]) -> Column:
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.contains(c, F.lit(t))
    return hit


def indexed_path(path: Column, include_private: bool = False) -> Column:
    """Whether a note at a relative path goes into the index: no excluded, hidden or private folder."""
    parts = F.split(path, "/")
    fine = ~F.exists(parts, lambda p: p.isin(EXCLUDED_FOLDERS) | F.startswith(p, F.lit(".")))
    for prefix in EXCLUDED_PREFIXES:
        fine = fine & (path != prefix) & ~F.startswith(path, F.lit(f"{prefix}/"))
    return fine if include_private else fine & (F.get(parts, F.lit(0)) != "08-Private")


def analysed_path(path: Column) -> Column:
    parts = F.split(path, "/")
    inbox = (F.get(parts, F.lit(0)) == "01-Inbox") & F.coalesce(F.get(parts, F.lit(1)) == "AI-Memory", F.lit(False))
    return indexed_path(path) & ~inbox & ~F.get(parts, F.lit(0)).isin(NOT_ANALYSED)


def path_class(path: Column) -> Column:
    """Top level, category, privacy and whether it is inbox or archive."""
    top = F.substring_index(path, "/", 1)
    return F.struct(
        top.alias("top"), F.lower(F.when(F.contains(top, F.lit("-")), F.regexp_extract(top, r"^[^-]*-(.*)$", 1)).otherwise(top)).alias("category"),
        F.when(top == "08-Private", "restricted").otherwise("private").alias("privacy"), (top == "01-Inbox").alias("inbox"), (top == "09-Archive").alias("archive"),
    )


def memory_scope(path: Column, flag: Column, folders: list[str]) -> Column:
    """(eligible, reason) of a note for automatic memory: its flag decides, then its folder."""
    dedicated = F.lit(False)
    for d in folders:
        dedicated = dedicated | (path == d) | F.startswith(path, F.lit(f"{d}/"))
    reason = (
        F.when(F.startswith(path, F.lit("/")) | F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit("/../")), "outside_vault")
        .when(~F.endswith(F.lower(path), F.lit(".md")), "non_markdown").when(flag == "false", "explicitly_disabled")
        .when(flag.isNotNull() & (flag != "true"), "invalid_frontmatter").when(flag == "true", "explicitly_enabled").when(dedicated, "authorized").otherwise("excluded_ordinary")
    )
    return F.struct(reason.isin("explicitly_enabled", "authorized").alias("eligible"), reason.alias("reason"))


def process_log_title(title: Column) -> Column:
    return title.rlike(PROCESS_LOG)


def notification_title(title: Column) -> Column:
    return _any(title, NOTIFICATION_MARKERS) & ~_any(title, CONCLUSION_MARKERS)


def failure_kind(error: Column, kinds: list[str]) -> Column:
    """The kind of the first marker found in a failure's text; 'other' for any other text, 'unknown' for none."""
    low = F.lower(F.coalesce(error, F.lit("")))
    out = F
    for marker, kind in zip(FAILURE_MARKERS, kinds, strict=True):
        out = out.when(F.contains(low, F.lit(marker.lower())), kind)
    return out.when(F.trim(low) != "", "other").otherwise("unknown")


def evidence_sufficient(kind: Column, refs: Column, least: int = 1) -> Column:
    distinct = F.size(F.array_distinct(F.filter(F.transform(refs, lambda x: F.trim(x)), lambda x: x != "")))
    return kind.isin(EXEMPT_TYPES) | (F.coalesce(distinct, F.lit(0)) >= max(least, 1))


def listed(cases: list[tuple[Column, str]]) -> Column:
    """Names of the cases that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in cases]))


def hard_findings(r: dict[str, Column]) -> Column:
    """Findings that bar automatic handling, in order. r has one column for each fact that the rules look at."""
    kind, empty = r["memory_type"], F.lit(False)
    for c in ("memory_id", "title", "content"):
        empty = empty | (F.coalesce(r[c].cast("string"), F.lit("")) == "")
    return listed([
        (empty, "schema_invalid"),
        (kind.isin("core", "core_memory") | (r["tier"] == "core"), "core_memory_requires_owner"),
        (F.lower(F.trim(r["operation"])).isin(DESTRUCTIVE), "destructive_operation_requires_owner"),
        (r["privacy_change"], "privacy_change_requires_owner"),
        (r["privacy"] == "restricted", "restricted_content_requires_owner"),
        ((r["target_project"] != "") & (F.size(r["projects"]) > 0) & ~F.array_contains(r["projects"], r["target_project"]), "cross_project_requires_owner"),
        (r["conflict"], "knowledge_conflict_requires_owner"),
        (kind.isin(DURABLE_TYPES) & ~r["evidence"], "insufficient_evidence_requires_owner"),
        (F.lower(r["source"]).isin(REPORT_SOURCES) & F.lower(r["report_status"]).isin(UNVERIFIED), "unverified_work_report_requires_owner"),
        (r["owner_authored"] | F.array_contains(r["tags"], "source/owner-manual"), "owner_authored_requires_owner"),
    ])


def policy_reasons(r: dict[str, Column]) -> Column:
    """Why a candidate is not promoted automatically, in order and each once."""
    kind, empty = F.lower(r["memory_type"]), F.lit(False)
    for c in ("memory_id", "title", "content"):
        empty = empty | (F.coalesce(r[c].cast("string"), F.lit("")) == "")
    confidence = r["confidence"]
    flags = F.array_sort(F.array_intersect(F.array_distinct(F.transform(r["flags"], lambda x: F.lower(F.trim(x)))), F.array(*map(F.lit, HIGH_RISK))))
    head = listed([
        (empty, "schema_invalid"),
        (confidence.isNull() | F.isnan(confidence) | (confidence < LEAST_CONFIDENCE), "confidence_below_threshold"),
        (~r["authoritative"], "direct_user_or_authoritative_source_required"),
        (F.size(r["refs"]) == 0, "evidence_required"),
        ((F.size(r["refs"]) > 0) & ~r["verifiable"], "evidence_reference_unverifiable"),
        (r["conflict"], "unresolved_conflict"),
        (r["ambiguous"], "duplicate_ambiguity"),
        (kind.isin("core", "core_memory") | (F.lower(r["tier"]) == "core"), "core_memory_requires_owner"),
        (F.lower(r["privacy"]).isin("restricted", "sensitive", "secret"), "restricted_requires_owner"),
    ])
    tail = listed([(kind.isin([k for k in HIGH_RISK if k not in ("core", "core_memory")]), "")])
    own = F.transform(tail, lambda _: F.concat(kind, F.lit("_requires_owner")))
    return F.array_distinct(F.concat(head, F.transform(flags, lambda f: F.concat(f, F.lit("_requires_owner"))), own))


def item_status(manifest: Column, job: Column) -> Column:
    """What an owner is told about an entry, from its job first, then from the manifest; queued is never called imported."""
    j, m = F.lower(F.coalesce(job, F.lit(""))), F.lower(F.coalesce(manifest, F.lit("")))
    merged = F.startswith(manifest, F.lit("job:")) & F.contains(manifest, F.lit(":existing"))
    return (
        F.when(j == "failed", "failed").when(j.isin("queued", "retrying", "running"), "processing").when(j == "completed", F.when(merged, "merged").otherwise("kept"))
        .when(m == "skipped_by_value_gate", "skipped").when(m == "queued", "pending").when(m == "failed", "failed").when(m == "processed", "kept").otherwise("pending")
    )


def card_freshness(source: Column, status: Column, reason: Column, timeless: Column) -> Column:
    """State of a card in time; reason is that of validity_reason without a look at the status, timeless allows missing bounds."""
    return (
        F.when(source.isin("revoked", "expired", "disabled", "archived"), "source_revoked")
        .when(status.isin("superseded", "invalidated", "archived", "rejected", "rolled_back", "repair_required"), status)
        .when(F.startswith(reason, F.lit("malformed")), "unknown").when(reason == "unbounded", F.when(timeless, "current").otherwise("unknown"))
        .when(reason == "expired", "overdue").when(reason == "not_yet_valid", "not_yet_current").otherwise("current")
    )


def card_action(source: Column, status: Column, freshness: Column, pending: Column, core: Column, available: Column, doubtful: Column) -> Column:
    """What an owner is asked to do; the first that applies."""
    stale = freshness.isin("superseded", "invalidated", "archived", "rejected", "rolled_back", "repair_required", "overdue", "source_revoked")
    return (
        F.when(source.isin("revoked", "expired", "disabled", "archived"), "reauthorize_source")
        .when(status.isin("needs_review", "received", "preparing") | pending, "confirm")
        .when(core & (status.isin("archived", "superseded") | freshness.isin("archived", "superseded")), "review")
        .when(core & ((status == "invalidated") | freshness.isin("overdue", "invalidated")), "invalidate")
        .when(core & (status.isin("active", "superseded") | available), "correct").when(stale, "review").when(doubtful, "review").otherwise("none")
    )


def platform(url: Column, hint: Column) -> Column:
    """Platform of a captured page by its host; a hint names channels, and other sites."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1))
    hinted = F.replace(F.lower(F.trim(F.coalesce(hint, F.lit("")))), F.lit("-"), F.lit("_"))
    out = F.when(hinted.isin("video_channel", "wechat_channels", "视频号"), "video_channel")
    for hosts, name in PLATFORMS:
        out = out.when(_any(host, hosts), name)
    return out.when(host == "youtu.be", "youtube").otherwise(F.when(hinted != "", hinted).otherwise("website"))


def sensitive(nested: Column) -> Column:
    """Whether any key of nested values, given as JSON, names something secret; values do not count."""
    keys = F.regexp_extract_all(nested, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1)
    return F.exists(keys, lambda k: k.rlike(SENSITIVE_KEYS))


def masked(pairs: Column) -> Column:
    """A map without the values of secret keys."""
    return F.transform_values(pairs, lambda k, v: F.when(k.rlike(SENSITIVE_KEYS), "[REDACTED]").otherwise(v))


def bare_url(c: Column) -> Column:
    """A URL without user, query and fragment, as it may be shown."""
    return F.regexp_replace(F.regexp_replace(c, r"[?#][\s\S]*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")


#: Least percentages of the acceptance gate (fixed values).
GATES = {"recall": 90, "citations": 95, "activation": 95, "tools": 95, "reduction": 90}


def gate(r: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(verdict, recall, reduction) of a run's figures: FAIL for any that was measured and is too low, BLOCKED where one was not
    measured, else PASS."""
    recall, reduction = 100.0 * r["hits"] / r["total"], (1 - r["rendered"] / r["baseline"]) * 100
    low = (recall < GATES["recall"]) | (reduction < GATES["reduction"])
    for name in ("citations", "activation", "tools"):
        low = low | (r[name] < GATES[name])
    odd = (r["answered"] != 100) | (r["baseline"] <= 0) | (r["rendered"] > r["baseline"]) | (r["leaks"] != 0) | (r["repeated"] != 0)
    for name in ("reviewed", "recovered"):
        odd = odd | F.coalesce(r[name] != 100, F.lit(False))
    open_ = r["reviewed"].isNull() | r["recovered"].isNull()
    return F.when(low | odd, "FAIL").when(open_, "BLOCKED").otherwise("PASS"), recall, reduction


#: Buckets of a failed question, the one that explains most first.
BUCKETS = ["provenance", "temporal", "retrieval", "context", "fallback", "mcp"]


def diagnosis(cases: list[tuple[Column, str, str]]) -> tuple[Column, Column]:
    """(failures in order, first bucket) of cases (condition, failure, bucket)."""
    bucket = F
    for b in BUCKETS:
        hit = F.lit(False)
        for c, _, own in cases:
            hit = hit | c if own == b else hit
        bucket = bucket.when(hit, b)
    return listed([(c, n) for c, n, _ in cases]), bucket.otherwise("")


def review_action(blocked: Column, manual: Column, same_scope: Column, noise: Column, enough: Column) -> Column:
    """What a review would do; the first that applies."""
    return (
        F.when(blocked, "blocked").when(manual, "requires_owner_review").when(same_scope, "would_append_evidence").when(noise, "would_auto_reject_noise")
        .when(enough, "would_auto_approve").otherwise("requires_owner_review")
    )


def parity_reason(used_a: Column, used_b: Column, most: Column, n_a: Column, n_b: Column, same: Column) -> Column:
    """Why two packs are not the same, or that they are."""
    return F.when((used_a > most) | (used_b > most) | (used_a != used_b), "bounds_mismatch").when((n_a == 0) & (n_b == 0), "retrieval_empty").when((n_a != n_b) | ~same, "schema_mismatch").otherwise("identity_and_bounds_equal")
