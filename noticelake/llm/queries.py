"""The queries opN_<name> of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, katz, language, licenses, merkle, mixing, neardup, packing, pii, pivots, sharding, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is set aside from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), docs.where(~held_out(4, 2)))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(4, 2))
    return toxicity.score(docs, labels).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.shard_plan(table(spark, sf_dir, "documents"), n_shards=8)
    return plan.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = F.filter("spans", lambda x: x["plain"])

    def digest(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(spans: Column, kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(plain, kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(digest(plain), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
        *[count(F.col("spans"), kind).alias(f"all_{kind}") for kind in pii.KINDS],
    )


def op6_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out(5, 1)).alias("learn"))
    scored = katz.score(docs)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    return merkle.verified(docs, held_out(7, 0))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _licence_sql() -> str:
    """The same canonical form and lookups in SQL, from the same fixed values."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    form = "lower(x)"
    for pattern, plain in licenses.SPELLINGS:
        form = f"regexp_replace({form}, {quoted(pattern)}, {quoted(plain.replace('$', chr(92)))}, 'g')"
    form = f"trim(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    line = f"case when not regexp_matches(lower(x), {quoted(licenses.COPYRIGHT_LINE)}) or regexp_matches(lower(x), {quoted(licenses.BUT)}) then nullif({form}, '') end"
    lines = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), {quoted(licenses.LINE_BREAK)}), lambda x: {line}), lambda x: x is not null)"
    values = lambda rows: ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in rows)
    return f"""with digests as (select id, sha256(array_to_string({lines}, ' ')) as digest from (values {values(licenses.TEXTS)}) k(id, text) union select * from (values {values(licenses.DIGESTS)}) k(id, digest)),
 known as (select digest, min(id) as id from digests group by 1),
 notice as (select distinct id, sha256(array_to_string({lines}, ' ')) as digest from (values {values(licenses.NOTICES)}) k(id, text)),
 base as (select row_number() over () as row, doc_id, {lines} as canonical from documents),
 hits as (select row, nth, id from (select row, unnest(canonical) as l, generate_subscripts(canonical, 1) as nth from base) join notice on sha256(l) = digest),
 per as (select row, count(distinct nth) as n, string_agg(distinct id, ',' order by id) as ids from hits group by 1)
 select b.doc_id, case when len(canonical) > 0 then sha256(array_to_string(canonical, ' ')) end as text_digest, id as license_id, coalesce(n, 0) as n_notices, coalesce(ids, '') as notice_ids
 from base b left join known on len(canonical) > 0 and sha256(array_to_string(canonical, ' ')) = digest left join per on b.row = per.row"""


#: All pairs of a label by exact cosine; components by the smallest vector that links reach.
_PIVOTS_SQL = f"""with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= {pivots.COSINE}),
 reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
 c as (select a, min(b) as component_id from reach group by 1), n as (select a, count(*) as n_links from links group by 1)
 select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join c on vec_id = c.a left join n on vec_id = n.a"""


def _merkle_sql() -> str:
    """Both trees level by level; a document's siblings are found by its place, and its root is folded along its way."""

    def framed(x: str) -> str:
        return f"case when {x} is null then '-' else strlen({x}::varchar) || ':' || {x}::varchar end"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(f"({framed(n_chars if f == 'n_chars' else f)})" for f in merkle.FIELDS) + ")"

    bits = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "case when b >= 0 then xor(a, b) else xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end) end"
    crc = f"xor(list_reduce({bits}, lambda a, b: {step}, 4294967295::bigint), 4294967295)"

    def up(source: str) -> str:
        """Levels of the trees of a source(tree, place, n, digest)."""
        return f"""select tree, 0 as lvl, place, n, digest from {source} union all
 select tree, lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by place)) from {source}_nodes where n > 1 group by tree, lvl, place // 2, n"""

    def walk(source: str, start: str) -> str:
        """A node's way up: its level, its place there, the siblings so far and what it folds to."""
        turned = "sha256(case when w.place % 2 = 1 then coalesce(s.digest, '') || w.node else w.node || coalesce(s.digest, '') end)"
        return f"""{start} union all
 select w.id, w.tree, w.lvl + 1, w.place // 2, (w.n + 1) // 2, w.proof || coalesce(s.digest, ''), {turned}
 from {source}_walk w left join {source}_nodes s on s.tree = w.tree and s.lvl = w.lvl and s.place = xor(w.place, 1) where w.n > 1"""

    return f"""with recursive base as (select doc_id, row_number() over () as id, case when lang is null then '-' else ':' || lang end as tree, {leaf("n_chars")} as digest,
 {leaf(f"(n_chars + case when coalesce({crc} % 7 = 0, false) then 1 else 0 end)")} as changed from documents),
 low as (select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as place, count(*) over (partition by tree) as n from base),
 low_nodes(tree, lvl, place, n, digest) as ({up("low")}),
 high as (select '' as tree, tree as name, digest, row_number() over (order by tree) - 1 as place, count(*) over () as n from low_nodes where n = 1),
 high_nodes(tree, lvl, place, n, digest) as ({up("high")}),
 low_walk(id, tree, lvl, place, n, proof, node) as ({walk("low", "select id, tree, 0, place, n, '', changed from low")}),
 high_walk(id, tree, lvl, place, n, proof, node) as ({walk("high", "select w.id, '', 0, h.place, h.n, w.proof, w.node from low_walk w join high h on h.name = w.tree where w.n = 1")}),
 top as (select digest as root from high_nodes where n = 1)
 select l.doc_id, l.digest as leaf, h.digest as subroot, root, sha256(w.proof) as proof_sha256, w.node as folded_root, w.node = root as verified
 from low l join high h on h.name = l.tree join high_walk w on w.id = l.id and w.n = 1, top"""


def oracle_sql() -> dict[str, str]:
    return {"op6_pivots": _PIVOTS_SQL, "op10_licenses": _licence_sql(), "op13_merkle": _merkle_sql()}
