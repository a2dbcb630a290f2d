"""The queries of this subpackage, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.media import text_media

    out = text_media(table(spark, sf_dir, "documents"))
    track = F.get("tracks", F.lit(0))
    keyframes = F.array_join(F.transform(track["keyframes"], lambda k: F.concat_ws("+", k["offset"], k["length"])), ";")
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        track["codec"].alias("codec"), track["duration"].alias("duration"), track["n_frames"].alias("n_frames"), keyframes.alias("keyframes"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.langid import identify_language

    return identify_language(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.spm import sentencepiece_digests

    return sentencepiece_digests(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.repair import read_ids, write_ids

    return read_ids(write_ids(table(spark, sf_dir, "documents")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": op1_media_columns,
        "op2_packing": op2_packing,
        "op3_token_counts": op3_token_counts,
        "op4_language": op4_language,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_main_text": op6_main_text,
        "op7_simhash": op7_simhash,
        "op8_token_ids": op8_token_ids,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_quality": op10_quality,
    }


#: The boxes of a stored text as hexadecimal numbers, with its ticks and frames in their places; the CRC is
#: reckoned bit by bit.
OP1_SQL = r"""
WITH raw AS (
  SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents
), sized AS (
  SELECT doc_id, raw, octet_length(raw) AS n_bytes, greatest(1, (octet_length(raw) + 575) // 576) AS frames FROM raw
), filled AS (
  SELECT doc_id, n_bytes, frames, frames * 576 AS ticks, raw || unhex(repeat('FF', frames * 576 - n_bytes)) AS payload FROM sized
), held AS (
  SELECT *, printf('%08x', ticks) AS t, printf('%08x', frames) AS f FROM filled
), media AS (
  SELECT *,
    unhex('000000186674797069736f6d0000020069736f6d6d703431')
    || unhex(printf('%08x', ticks + 8) || '6d646174') || payload
    || unhex(
      '000001f56d6f6f76'
      || '0000006c6d766864' || '000000000000000000000000' || '00001f40' || t || '00010000' || '0100' || repeat('00', 10)
      || '000100000000000000000000000000000001000000000000000000000000000040000000' || repeat('00', 24) || '00000002'
      || '000001817472616b'
      || '0000005c746b6864' || '00000007' || '0000000000000000' || '00000001' || '00000000' || t || repeat('00', 12) || '0100' || '0000'
      || '000100000000000000000000000000000001000000000000000000000000000040000000' || repeat('00', 8)
      || '0000011d6d646961'
      || '000000206d646864' || '000000000000000000000000' || '00001f40' || t || '55c40000'
      || '0000002168646c72' || '0000000000000000' || '736f756e' || repeat('00', 13)
      || '000000d46d696e66'
      || '00000010736d6864' || repeat('00', 8)
      || '0000002464696e66' || '0000001c64726566' || '0000000000000001' || '0000000c75726c2000000001'
      || '000000987374626c'
      || '0000003473747364' || '0000000000000001' || '0000002472617720' || '0000000000000001' || repeat('00', 8) || '0001' || '0008' || '00000000' || '1f400000'
      || '0000001873747473' || '0000000000000001' || f || '00000240'
      || '0000001c73747363' || '0000000000000001' || '00000001' || f || '00000001'
      || '000000147374737a' || '00000000' || '00000240' || f
      || '000000147374636f' || '0000000000000001' || '00000020'
    ) AS media
  FROM held
), tail AS (
  SELECT *, right(hex(payload), 64) AS last FROM media
), bits AS (
  SELECT *, list_transform(range(0, 256), lambda k: (('0x' || substr(last, 2 * (k // 8) + 1, 2))::BIGINT >> (k % 8)::BIGINT) & 1) AS bit FROM tail
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, ticks::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256,
  xor(list_reduce(list_concat([4294967295]::BIGINT[], bit::BIGINT[]),
                  lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)::BIGINT AS tail_crc32,
  octet_length(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256,
  'codec=raw;seconds=' || printf('%.6f', ticks / 8000.0::DOUBLE) || ';frames=' || frames || ';keyframes=' || frames
    || ';last=' || (32 + 576 * (frames - 1)) || '+576' AS feature,
  'raw ' AS codec, ticks / 8000.0::DOUBLE AS duration, frames::BIGINT AS n_frames,
  array_to_string(list_transform(range(0, frames), lambda k: (32 + 576 * k) || '+576'), ';') AS keyframes
FROM bits
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_media_columns": OP1_SQL, "op9_exact_dedup": OP9_SQL}
