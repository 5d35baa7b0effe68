"""The registered queries of the training-data operators, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import strip_white_space, text_or_empty
from .exact_dedup import exact_duplicates
from .fingerprints import fingerprint_pairs
from .html_extract import extract_main_text
from .kd_shards import kd_shards
from .merkle import FANOUT, folded, leaf_hash, merkle_manifest, proof_hash
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .packing import pack
from .pii import find_personal_data
from .quality import quality_scores
from .secrets import KINDS as SECRET_KINDS
from .secrets import find_secrets
from .tokens import token_counts
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    crc = F.crc32(text_or_empty().cast("binary")).cast("long")
    out = kd_shards(docs, ["doc_id", "n_chars", "source", "lang"], shards=16, carry={"text_crc32": crc})
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1
    out = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=~fold("doc_id"))
    return out.select("doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    digest = F.sha2(strip_white_space(text_or_empty()), 256)
    return exact_duplicates(docs, carry={"text_sha256": digest}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["name"].isNull()))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, SECRET_KINDS), F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(crc % 3 == 0, leaf_hash(*map(F.col, ("doc_id", "source", "lang", "n_chars")), lower))
    out = merkle_manifest(_table(spark, sf_dir, "documents"), fanout=FANOUT, carry={"tampered": tampered})
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_kd_shards": op1_kd_shards,
    "op2_ngram_join": op2_ngram_join,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_fingerprints": op4_fingerprints,
    "op6_token_counts": op6_token_counts,
    "op7_personal_data": op7_personal_data,
    "op9_main_text": op9_main_text,
    "op5_source_mix": op5_source_mix,
    "op8_exact_dedup": op8_exact_dedup,
    "op10_length_packing": op10_length_packing,
    "op11_whitening": op11_whitening,
    "op12_secret_scan": op12_secret_scan,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op2_ngram_join": r"""
        with recursive w as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) as word,
            generate_subscripts(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), 1) as pos from documents),
        five as (select doc_id, pos, count(*) over (partition by doc_id) as n, concat_ws(' ', word, lead(word, 1) over p, lead(word, 2) over p, lead(word, 3) over p, lead(word, 4) over p) as s
          from w window p as (partition by doc_id order by pos)),
        sh as (select distinct doc_id, s from five where pos <= n - 4 or (n < 5 and pos = 1)),
        size as (select doc_id, count(*) as n from sh group by doc_id),
        both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
        link as (select a, b from both_ join size x on x.doc_id = a join size y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
        reach as (select a as src, a as dst from link union select r.src, l.b from reach r join link l on l.a = r.dst),
        low as (select src, min(dst) as component from reach group by src)
        select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.component, d.doc_id) as component_id
        from documents d left join size s using (doc_id) left join low l on l.src = d.doc_id""",
    "op8_exact_dedup": r"""
        with t as (select doc_id, coalesce(text, '') as text,
                     regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
        g as (select norm, count(*) as group_size,
                arg_min(doc_id, (-length(text), doc_id)) as keep_id from t group by norm)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
        from t join g on t.norm = g.norm""",
}

_FIELD = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || cast({0} as varchar) end"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _levels(name: str, leaves: str) -> str:
    """A recursive table of all levels, and one of what stands beside each node in its run."""
    beside = lambda rows: f"coalesce(string_agg(h, '') over (partition by l, g, i // 8 order by i rows between {rows}), '')"
    return f"""{name} as (select 0 as l, g, i, n, h from {leaves} union all select l + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from {name} where n > 1 group by l, g, i // 8, n),
        {name}_by as (select l, g, i, {beside("unbounded preceding and 1 preceding")} as a, {beside("1 following and unbounded following")} as b from {name} where n > 1)"""


def _walk(name: str, levels: str, start: str) -> str:
    """From each start up to where nothing stands beside: the folded hash and all siblings on the way."""
    return f"""{name}_all as (select * from {start} union all select w.row, w.g0, w.l + 1, w.g, w.i // 8, sha256(s.a || w.h || s.b), w.proof || s.a || s.b
          from {name}_all w join {levels}_by s on s.l = w.l and s.g = w.g and s.i = w.i),
        {name} as (select row, g0, arg_max(h, l) as h, arg_max(proof, l) as proof from {name}_all group by row, g0)"""


ORACLES["op13_merkle_manifest"] = f"""
        with recursive crc_table as (select list_transform(range(256), lambda v: list_reduce(list_concat([v], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
        hashed as (select doc_id, coalesce('=' || lang, '') as g, sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) as h,
          sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))} || {_FIELD.format(_LOWER)}) as low,
          xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) as crc
          from documents, crc_table),
        leaves as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i, count(*) over (partition by g) as n, row_number() over () as row from hashed),
        {_levels("tree", "leaves")},
        subroots as (select g as lang, '' as g, h, row_number() over (order by g) - 1 as i, count(*) over () as n from tree where n = 1),
        {_levels("above", "subroots")},
        top as (select h as root from above where n = 1),
        {_walk("path", "tree", "(select row, g as g0, 0 as l, g, i, case when crc % 3 = 0 then low else h end as h, '' as proof from leaves)")},
        {_walk("upper", "above", "(select p.row, p.g0, 0 as l, s.g, s.i, p.h, p.proof from path p join subroots s on s.lang = p.g0)")}
        select v.doc_id, v.h as leaf, s.h as subroot, root, sha256(u.proof) as proof_sha256, u.h as folded_root, u.h = root as verified
        from leaves v join upper u on u.row = v.row join subroots s on s.lang = v.g, top"""
