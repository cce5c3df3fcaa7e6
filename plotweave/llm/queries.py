"""The registered queries of this subpackage; each applies one operator to a whole table."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm import ball_kmeans, bpe, host_quality, language_id, line_dedup, media, mixing, ngram_lm, quality_fm, secrets, simhash, spelling, warc
from plotweave.llm.common import table

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANK_FILE, PATTERN)
    return bpe.decode(encoded, RANK_FILE, PATTERN).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return warc.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), RANK_FILE, PATTERN)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


HELD_OUT = 7, 2


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prepared = ngram_lm.prepared(docs, language_id.remainder("doc_id", HELD_OUT[0]) == HELD_OUT[1])
    model = ngram_lm.train(prepared)
    n, v = model.words.total, model.words.types
    scored = ngram_lm.score(prepared, model)
    base = F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


LANGUAGE_FOLDS = 5


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = language_id.remainder("doc_id", LANGUAGE_FOLDS)
    model = language_id.fit(docs.filter(F.coalesce(rest, F.lit(0)) != 0))
    return language_id.predict(docs, model).select("doc_id", F.coalesce(rest == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "bits")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    places = F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["shard"].cast("string"), p["position"].cast("string"))), ",")
    return mixing.words_taken(mixed).select("doc_id", "size", "source_size", "target", "taken", "copies", F.coalesce(places, F.lit("")).alias("places"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = media.store(table(spark, sf_dir, "documents"))
    return media.described(media.read(kept)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=spelling.ERROR_EVERY)


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_kmeans.cluster(table(spark, sf_dir, "embeddings"))
    components = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(components, 256).alias("centroid_sha256"))


QUALITY_FOLDS = 4, 2
#: Scores from this on are predicted to be of label 1.
QUALITY_CUT = 0.7


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    folds, held_out = QUALITY_FOLDS
    learned = labels.filter(language_id.remainder("doc_id", folds) != held_out)
    scored = quality_fm.score(docs, quality_fm.fit(docs, learned, label_col="quality", metadata=("n_chars",)))
    rest = F.coalesce(language_id.remainder("doc_id", folds) == held_out, F.lit(False))
    return scored.select("doc_id", rest.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_katz": op2_katz,
    "op3_host_quality": op3_host_quality,
    "op4_warc": op4_warc,
    "op5_secrets": op5_secrets,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_lines": op9_lines,
    "op10_media": op10_media,
    "op11_spelling": op11_spelling,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_quality": op13_quality,
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_DIGESTED = "select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages"



def _spelling_sql() -> str:
    """Words of checksummed runs; near words are those that share what is left without one code point."""
    letters, least, count, ratio, every = spelling.LETTERS, spelling.MIN_LENGTH, spelling.MIN_COUNT, spelling.RATIO, spelling.ERROR_EVERY
    return f"""with recursive t as materialized (select list(c order by i) as crc from (select i, list_reduce(list_prepend(i, range(8)), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) as r(i))),
 o as (select coalesce(doc_id::varchar, '') as doc, translate(unnest(regexp_extract_all(text, '[{letters}]{{{least},}}')), '{spelling.UPPER}', '{spelling.LOWER}') as run from documents),
 g as (select run, count(*) as n, list_transform(string_split(doc || ':' || run, ''), lambda x: unicode(x)) as p from o group by doc, run),
 b as (select run, n, flatten(list_transform(p, lambda x: case when x < 128 then [x::bigint] else [192 + (x >> 6)::bigint, 128 + (x & 63)::bigint] end)) as b from g),
 h as (select run, n, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t.crc[(xor(a, x) & 255) + 1])), 4294967295) as h from b, t),
 m as (select case when h % {every} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h),
 w as materialized (select word, sum(n)::bigint as n from m where length(word) >= {least} group by 1 having sum(n) >= {count}),
 i as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
 d as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from i),
 e as (select a.word, b.word as near, b.n as near_n from d as a join d as b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select d.word, w.word, w.n from d join w on d.cut = w.word union select w.word, d.word, d.n from d join w on d.cut = w.word),
 c as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as best, max(near_n) as best_n from e group by 1),
 f as materialized (select w.word, n, coalesce(n_near, 0) as n_near, case when best_n >= {ratio} * n then best end as form, case when best_n >= {ratio} * n then best_n end as form_n from w left join c on w.word = c.word),
 r as (select word, word as last_word, 0 as depth from f union all select r.word, f.form, depth + 1 from r join f on r.last_word = f.word where f.form is not null),
 z as (select word, arg_max(last_word, depth) as root from r group by 1)
 select f.word, form, root, n, n_near, form_n from f join z on f.word = z.word"""


def _kmeans_sql() -> str:
    """Lloyd's rounds, one after the other, in doubles that hold the integers exactly."""
    k, rounds, dims, units, seed = ball_kmeans.CLUSTERS, ball_kmeans.ROUNDS, ball_kmeans.DIMENSIONS, ball_kmeans.UNITS, ball_kmeans.SEED
    parts = [
        f"""e as (select vec_id, embedding::double[] as x from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda y: y is not null and isfinite(y))) = {dims})""",
        f"""v as materialized (select row_number() over () as r, vec_id, list_transform(x, lambda y: floor({units} * y)) as v from e)""",
        f"""c0 as materialized (select row_number() over (order by h, v) - 1 as c, v from (select sha256('{seed}:' || coalesce(vec_id::varchar, '')) as h, v from v) order by h, v limit {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (select * from (select r, vec_id, v.v, c, list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c{i}.v) + list_inner_product(c{i}.v, c{i}.v) as d from v cross join c{i})
 qualify row_number() over (partition by r order by d, c) = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} as materialized (with p as (select c, unnest(v) as x, generate_subscripts(v, 1) as k from a{i}), s as (select c, k, sum(x)::bigint as s, count(*)::bigint as n from p group by 1, 2),
 m as (select c, list(((s - ((s % n) + n) % n) // n)::double order by k) as v from s group by 1) select c{i}.c, coalesce(m.v, c{i}.v) as v from c{i} left join m on c{i}.c = m.c)""")
    t = f"a{rounds}"
    return f"""with {", ".join(parts)} select vec_id, {t}.c::int as cluster, d::bigint as distance, sum(d) over (partition by {t}.c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
 sha256(array_to_string(list_transform(c{rounds}.v, lambda y: y::bigint::varchar), ',')) as centroid_sha256 from {t} join c{rounds} on {t}.c = c{rounds}.c"""


#: SQL twins of the queries that SQL can express; tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_host_quality": rf"""with d as (select doc_id, source, coalesce(text, '') as text, {_WORDS} as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l from documents),
 t as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from d), g as (select doc_id, i, w[i:i+2] as g from t),
 r as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
 m as (select doc_id, count(distinct i + k) as n_repeat_words from r, range(3) as o(k) group by 1),
 c as (select d.doc_id, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from d left join m on d.doc_id = m.doc_id),
 b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
 h as (select source, count(*)::double as n, sum(base_failed::int)::double as f from b where source is not null group by 1),
 s as (select count(*)::double as m, sum(n) as n, sum(n * n) as nn, sum(f * f / n) as ff, sum(f) / sum(n) as mean from h),
 e as (select *, mean * (1 - mean) as v, n - nn / n - (m - 1) as room from s),
 q as (select mean, 1 / least(1 - 1e-6, greatest(1e-6, case when v > 0 and room > 0 then (ff - n * mean * mean - v * (m - 1)) / (v * room) else 1e-6 end)) - 1 as strength from e)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce((h.f + mean * strength) / (h.n + strength) <= {host_quality.MAX_RATE}, true) as kept
 from b cross join q left join h on b.source = h.source""",
    "op4_warc": f"""with p as ({_DIGESTED}), m as (select payload_digest, max(page_id) as last from p where payload_bytes >= {warc.MIN_REVISIT} group by 1)
 select page_id, payload_bytes, p.payload_digest, case when page_id < last then 'revisit' else 'response' end as record_type, case when page_id < last then last end as refers_to
 from p left join m on p.payload_digest = m.payload_digest""",
    "op11_spelling": _spelling_sql(),
    "op12_ball_kmeans": _kmeans_sql(),
    "op9_lines": f"""with r as (select row_number() over () as r, doc_id, coalesce(doc_id, -9223372036854775808) as own, string_split(coalesce(text, ''), chr(10)) as t from documents),
 l as (select r, doc_id, own, unnest(t) as line, generate_subscripts(t, 1) as i from r),
 k as (select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as s from l),
 n as (select *, translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from k),
 c as (select key, max(own) as last from n where length(key) >= {line_dedup.MIN_CHARS} group by key having count(distinct r) >= {line_dedup.MIN_DOCS}),
 j as (select n.*, c.key is not null and last <> own as lost from n left join c on n.key = c.key)
 select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) as kept_sha256 from j group by r""",
}
