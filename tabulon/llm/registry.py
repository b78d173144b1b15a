"""The thin queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import linededup, media, mixing, packing, quality, sharding, simhash, substring, toxicity, urlfilter
from tabulon.llm.common import utf8_size

BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BPE.replace(".json", ".tiktoken")), public_tokenizers.PATTERN


def added_tokens() -> dict[str, int]:
    """The vocabulary's added tokens, whose strings in a text are one id each."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path(BPE), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file(), added=added_tokens())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return dealt.select("doc_id", (utf8_size(F.col("text")) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(_table(spark, sf_dir, "documents"))
    pairs = F.transform(F.arrays_zip("times", "codes"), lambda p: F.concat_ws(":", F.hex(p["times"]), F.hex(p["codes"])))
    return found.withColumn("feature", F.array_join(pairs, " ")).drop("times", "codes")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_pack": op2_pack, "op3_simhash": op3_simhash, "op4_shard": op4_shard, "op5_quality": op5_quality, "op6_mix": op6_mix, "op7_media": op7_media, "op8_lines": op8_lines, "op9_urls": op9_urls, "op10_substring": op10_substring}


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (SELECT l.source, l.source_size, coalesce(least(l.cap, l.weight * f.level), l.cap) AS target FROM l, f),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(rate)::BIGINT AS whole, target - floor(rate) * source_size AS wanted,
    CASE WHEN rate > floor(rate) THEN (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) END AS rank FROM r),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN rank IS NOT NULL AND upto - size / 2.0::DOUBLE <= wanted THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""


OP8_SQL = r"""
WITH l0 AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
l1 AS (SELECT doc_id, line, ('0x' || substr(md5(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 1, 15))::BIGINT AS h,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM l0),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos FROM l1 WHERE words > 0),
g AS (SELECT doc_id, pos, h, lead(h) OVER (PARTITION BY doc_id ORDER BY pos) AS h2 FROM l),
v AS (SELECT *, xor(h >> 1, h2) AS v, count(*) OVER (PARTITION BY doc_id) AS m FROM g WHERE h2 IS NOT NULL),
win AS (SELECT a.doc_id, a.pos AS start, arg_min(b.pos, (b.v::HUGEINT * 1000000 + b.pos)) AS pos
  FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 2
  WHERE a.pos <= greatest(a.m - 3, 0) GROUP BY a.doc_id, a.pos),
f AS (SELECT DISTINCT v.doc_id, v.pos, v.h AS k1, v.h2 AS k2 FROM win JOIN v USING (doc_id, pos)
  UNION ALL SELECT doc_id, pos, h, -1 FROM l WHERE words >= 25),
first AS (SELECT k1, k2, min((doc_id, pos)) AS at FROM f GROUP BY k1, k2),
hit AS (SELECT DISTINCT f.doc_id AS d, f.pos AS p, first.at[1] AS d0, f.pos - first.at[2] AS shift FROM f JOIN first USING (k1, k2) WHERE (f.doc_id, f.pos) > first.at),
diagonal AS (SELECT DISTINCT d, d0, shift FROM hit),
equal AS (SELECT d, d0, shift, a.pos, a.line, a.pos - row_number() OVER (PARTITION BY d, d0, shift ORDER BY a.pos) AS island
  FROM diagonal JOIN l a ON a.doc_id = d JOIN l b ON b.doc_id = d0 AND b.pos = a.pos - shift AND a.h = b.h),
runs AS (SELECT DISTINCT d, d0, shift, island FROM equal JOIN hit USING (d, d0, shift) WHERE hit.p = equal.pos),
gone AS (SELECT DISTINCT d AS doc_id, line FROM equal JOIN runs USING (d, d0, shift, island)),
kept AS (SELECT l0.doc_id, count(*) AS n_lines, count(gone.line) AS n_removed,
    coalesce(string_agg(x, chr(10) ORDER BY l0.line) FILTER (WHERE gone.line IS NULL), '') AS text
  FROM l0 LEFT JOIN gone ON gone.doc_id = l0.doc_id AND gone.line = l0.line GROUP BY l0.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(kept.text) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
win AS (SELECT doc_id, p, md5(string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS h FROM w QUALIFY p + 20 <= n),
late AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM late, range(20) t(k)),
kept AS (SELECT w.doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY w.p) FILTER (WHERE gone.p IS NULL) AS text
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mix": OP6_SQL, "op8_lines": OP8_SQL, "op10_substring": OP10_SQL}
