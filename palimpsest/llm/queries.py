"""Queries of the ten operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import codes, decontaminate, importance, language, mixing, near_dedup, packing, quality, substring, telephony, token_store, tokens, toxicity
from palimpsest.llm._shared import documents, materialise, remainder

BYTE_BPE = "byte_bpe_50k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), capacity=2048, with_ids=False)
    return packing.pack(pieces, capacity=2048)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), threshold=0.8)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item that a document holds, however many items share what it holds of it."""
    return decontaminate.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), once=False, shared=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), limit=512)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.filter(remainder("doc_id", 4) != 2))
    return language.identify(docs, model).withColumn("held_out", remainder("doc_id", 4) == 2)


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec follows from the payload's checksum, so that all three occur and equal texts stay equal."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(text)
    padded = F.greatest(F.ceil(size / 192), F.lit(1)) * 192
    payload = F.concat(text, F.repeat(F.lit(" "), (padded - size).cast("int")).cast("binary"))
    codec = F.element_at(F.array(F.lit("mulaw"), F.lit("alaw"), F.lit("adpcm")), (F.crc32("payload") % 3 + 1).cast("int"))
    made = documents(spark, sf_dir).select("doc_id", payload.alias("payload"), size.cast("long").alias("n_bytes")).withColumn("codec", codec)
    stored = materialise(telephony.store_media(made.withColumn("key", F.struct("doc_id", "n_bytes")), id_col="key"), "media")
    return telephony.describe_media(stored, rate=16000, id_col="key").select("key.*", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_store.write_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), end_id=0)
    read = token_store.read_documents(written)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit(documents(spark, sf_dir), labels.filter(remainder("doc_id", 5) != 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), toxicity_model(spark, sf_dir)).withColumn("held_out", remainder("doc_id", 5) == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    return quality.score(docs, model, threshold=0.3).withColumn("held_out", remainder("doc_id", 5) == 0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring.remove_repeats(docs, window=20).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=10, least_words=20, n=1)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2, scale=256)
    return codes.with_label_error(coded).drop("label").withColumn("codebooks_sha256", F.lit(codes.digest(books)))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(documents(spark, sf_dir), weights=(1, 2, 3), percent=100, most=3))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_WORDS = "select doc_id, unnest(words) as word, unnest(range(len(words))) as i, len(words) as n from (select doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') as words from {table})"

OP2_SQL = f"""
with recursive texts as (select min(doc_id) as doc_id, text from documents where text is not null group by text),
words as ({_WORDS.format(text="text", table="texts")}),
runs as (select doc_id, n, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 4 following) as shingle, count(*) over (partition by doc_id order by i rows between current row and 4 following) as size, i from words),
shingles as (select distinct doc_id, shingle from runs where size = 5 or (n < 5 and i = 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reached(node, root) as (select doc_id, doc_id from texts union select l.b, r.root from reached r join both_ways l on l.a = r.node),
named as (select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id from documents d left join texts t on t.text = d.text left join (select node, min(root) as class_id from reached group by node) c on c.node = t.doc_id)
select doc_id, class_id, count(*) over (partition by class_id) as n_in_class, doc_id = class_id as keep from named
"""

OP10_SQL = f"""
with words as ({_WORDS.format(text="coalesce(text, '')", table="documents")}),
suffixes as (select doc_id, i, word, string_agg(word, ' ') over w as label, count(*) over w as size from words window w as (partition by doc_id order by i rows between current row and 19 following)),
leaves as (select doc_id, i, row_number() over (partition by label order by doc_id, i) as leaf from suffixes where size = 20),
marked as (select s.doc_id, s.i, s.word, max(case when leaf > 1 then 1 else 0 end) over (partition by s.doc_id order by s.i rows between 19 preceding and current row) as gone from suffixes s left join leaves l on l.doc_id = s.doc_id and l.i = s.i),
told as (select doc_id, count(*) as n_words, cast(sum(gone) as bigint) as n_removed, sha256(coalesce(string_agg(word, ' ' order by i) filter (where gone = 0), '')) as kept_sha256 from marked group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256 from documents d left join told t on t.doc_id = d.doc_id
"""


_RUNS = "select {id} as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from {table}"
_NIBBLE = "(instr('0123456789ABCDEF', {}) - 1)"

#: crc32 is a fold over bytes of a fold over bits.
OP11_SQL = f"""
with docs as ({_RUNS.format(id="doc_id", table="documents")}), items as ({_RUNS.format(id="item_id", table="benchmark")}),
s_words as (select word, count(*) as n from (select unnest(words) as word from docs) group by word),
t_words as (select word, count(*) as n from (select unnest(words) as word from items) group by word),
hexes as (select word, hex(word) as h from (select word from s_words union select word from t_words)),
bytes as (select word, list_transform(range(1, len(h), 2), lambda i: {_NIBBLE.format("h[i:i]")} * 16 + {_NIBBLE.format("h[i+1:i+1]")}) as b from hexes),
crcs as (select word, xor(list_reduce(list_concat([4294967295::bigint], b), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 10000 as bucket from bytes),
s_all as (select bucket, sum(n) as s from s_words join crcs using (word) group by bucket), t_all as (select bucket, sum(n) as t from t_words join crcs using (word) group by bucket),
totals as (select (select coalesce(sum(n), 0) from s_words)::double as s_n, (select coalesce(sum(n), 0) from t_words)::double as t_n),
gains as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (s_n + 10000) / ((s + 1.0::double) * (t_n + 10000))))::bigint as gain from s_all left join t_all using (bucket) cross join totals),
weights as (select id, sum(gain)::bigint as weight from (select id, unnest(words) as word from docs) join crcs using (word) join gains using (bucket) group by id),
scored as (select d.id as doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score from docs d left join weights w on w.id = d.id),
ranked as (select *, row_number() over (order by (n_features >= 20) desc, score desc, doc_id) as place, count(*) filter (where n_features >= 20) over () as able from scored)
select doc_id, n_features, weight, score, case when place <= 10 * able // 100 then place end as rank from ranked
"""

def _assigned(books: str) -> str:
    square = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))"
    return f"select vec_id, label, part, min(struct_pack(d := {square}::bigint, entry := b.entry)) as best, any_value(x.v) as v from parts x join {books} b using (part) group by vec_id, label, part"


def _moved(assigned: str, books: str) -> str:
    means = f"select part, entry, list(mean order by i) as v from (select part, best.entry as entry, i, floor(sum(v[i]) / count(*))::bigint as mean from (select *, unnest(range(1, len(v) + 1)) as i from {assigned}) group by 1, 2, 3) group by part, entry"
    return f"select b.part, b.entry, coalesce(m.v, b.v) as v from {books} b left join ({means}) m using (part, entry)"


OP12_SQL = f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select vec_id, label, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] as v from kept cross join (select unnest(range(16)) as part)),
books_0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v from parts where vec_id in (select vec_id from kept order by vec_id limit 64)),
assigned_0 as ({_assigned("books_0")}), books_1 as ({_moved("assigned_0", "books_0")}),
assigned_1 as ({_assigned("books_1")}), books_2 as ({_moved("assigned_1", "books_1")}),
assigned_2 as ({_assigned("books_2")}),
coded as (select vec_id, label, string_agg(lpad(lower(to_hex(best.entry)), 2, '0'), '' order by part) as code, sum(best.d)::bigint as error from assigned_2 group by vec_id, label),
digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from books_2)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded cross join digest
"""

OP13_SQL = """
with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents),
sources as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from sized group by source),
timed as (select *, sum(source_size) over ()::bigint as budget, source_size * 3 / weight as used_up, sum(weight) over () as all_weight from sources),
levels as (select *, (budget - coalesce(sum(source_size * 3) over earlier, 0))::double / (all_weight - coalesce(sum(weight) over earlier, 0)) as level from timed window earlier as (order by used_up, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (select source, source_size, weight, budget, least((source_size * 3)::double, weight * max(level) over ()) as target from levels),
queue as (select row_number() over () as row, doc_id, d.source, size, source_size, weight, budget, target, coalesce(sum(size) over (partition by d.source order by sha256('2024:' || doc_id), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as ahead from sized d join targets t on d.source is not distinct from t.source),
copies as (select *, ahead + (copy - 1) * source_size as start from queue cross join (select unnest([1, 2, 3]) as copy)),
served as (select *, greatest(0, least(size, ceil(target)::bigint - start)) as words from copies),
placed as (select *, coalesce(sum(words) over (order by (start + words) / weight, source nulls last, start rows between unbounded preceding and 1 preceding), 0) as position from served)
select doc_id, size, source_size, target, sum(greatest(0, least(words, budget - position)))::bigint as taken from placed group by row, doc_id, size, source_size, target
"""


def oracle_sql() -> dict[str, str]:
    """The operators with exact results that SQL can say; the others need tokenizers, models, codecs or templates."""
    return {"op2_near_dedup": OP2_SQL, "op10_substring_dedup": OP10_SQL, "op11_importance": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_mixing": OP13_SQL}
