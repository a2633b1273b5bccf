"""The dealt operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    centroids,
    langid,
    lines,
    mixing,
    neighbours,
    ngrams,
    omh,
    pieces,
    simhash,
    suffixes,
    tokencounts,
    tokenizers,
    vectorcodes,
)
from .common import WORD_PATTERN, keep, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_bpe_encode_decode")
def op6(spark: SparkSession, d: str) -> DataFrame:
    """Digests of every text's token ids and of the text they decode to."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizers.content()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op3_language_id")
def op3(spark: SparkSession, d: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that are not held out."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    out = langid.held_out("doc_id")
    learned = langid.sample(docs.where(~out))
    return langid.identify(docs.select("doc_id", "text", out.alias("held_out")), learned).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


@query(
    "op8_line_dedup",
    """
    with cut as (select doc_id, text, source, string_split(text, chr(10)) ls from documents where text is not null),
    l as (select distinct coalesce('s' || source, '') site, text, unnest(ls) line from cut),
    wide as (
        select line from l where length(trim(line)) > 0 group by line
        having count(distinct site) >= 5 and count(distinct text) >= 2),
    placed as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) i from cut),
    kept as (
        select a.doc_id, string_agg(a.line, chr(10) order by i) filter (w.line is null) body,
               count(*) filter (w.line is not null) n_removed, count(*) n_lines
        from placed a left join wide w on a.line = w.line group by a.doc_id)
    select d.doc_id, coalesce(k.n_lines, 0)::bigint n_lines, coalesce(k.n_removed, 0)::bigint n_removed,
           sha256(coalesce(k.body, '')) kept_sha256
    from documents d left join kept k on k.doc_id = d.doc_id
    """,
)
def op8(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the lines that five sources or more share, the sources of all copies included."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    sized = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long"))
    clean = lines.without_boilerplate(sized, removed="n_removed")
    return clean.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query(
    "op10_mix_sources",
    f"""
    with d as (
        select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::bigint size from documents),
    sized as (select source, sum(size)::bigint source_size from d group by source),
    numbered as (select *, row_number() over (order by source nulls last) s from sized),
    weighed as (
        select *, case (s - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end w,
               source_size * 3 cap from numbered),
    filled as (
        select *, (sum(source_size) over () - coalesce(sum(cap) over o, 0))::double
                  / (sum(w) over () - coalesce(sum(w) over o, 0)) lvl
        from weighed window o as (order by cap / w, s rows between unbounded preceding and 1 preceding)),
    aims as (
        select source, source_size, least(cap::double, w * (select max(lvl) from filled where lvl <= cap / w)) target
        from filled),
    blocks as (select doc_id, source, size, unnest(range(0, size, 512)) start from d where size > 0),
    keyed as (
        select doc_id, source, start // 512 block, least(512, size - start) words,
               ('0x' || substr(md5('0:' || doc_id || ':' || (start // 512)), 1, 15))::bigint h from blocks),
    placed as (
        select k.*, a.source_size, a.target, floor(a.target / a.source_size) passes,
               coalesce(sum(words) over (partition by k.source order by h, doc_id, block
                                         rows between unbounded preceding and 1 preceding), 0) + words / 2.0 mid
        from keyed k join aims a on k.source is not distinct from a.source),
    took as (
        select doc_id, sum(words * (passes + (mid <= target - passes * source_size)::int))::bigint taken
        from placed group by doc_id)
    select d.doc_id, d.size, a.source_size, a.target, coalesce(t.taken, 0)::bigint taken
    from d join aims a on d.source is not distinct from a.source left join took t using (doc_id)
    """,
)
def op10(spark: SparkSession, d: str) -> DataFrame:
    """How many words of every document the mix takes, in blocks of 512 words over eight shards."""
    sized = keep(
        table(spark, d, "documents").select(
            "doc_id", "source", mixing.words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")
        )
    )
    draws, aims = mixing.mix(sized, "doc_id", "size", "source", tie="tie")
    took = draws.groupBy("row", "tie").agg(F.sum("words").cast("long").alias("taken"))
    return (
        sized.join(aims, sized["source"].eqNullSafe(aims["source"]))
        .join(took, sized["doc_id"].eqNullSafe(took["row"]) & (sized["tie"] == took["tie"]), "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


@query(
    "op9_nearest_vectors",
    """
    with v as (
        select vec_id, embedding::double[] x from embeddings
        where embedding is not null and vec_id is not null
          and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
          and len(list_filter(embedding, lambda e: e <> 0)) > 0),
    s as (
        select q.vec_id query_id, c.vec_id, list_inner_product(q.x, c.x) score
        from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) k from s)
    select query_id, k::int rank, vec_id, score from r where k <= 20
    """,
)
def op9(spark: SparkSession, d: str) -> DataFrame:
    """The 20 vectors with the largest inner product for every twentieth vector."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors.where("vec_id % 20 = 0"), vectors)


@query("op4_order_minhash")
def op4(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return omh.edit_test(table(spark, d, "documents"))


@query("op5_ngram_scores")
def op5(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all documents, learned from those outside fold 1 of 5."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = langid.held_out("doc_id", fold=1)
    found = ngrams.score(docs, "doc_id", "text", ~out)
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_suffix_dedup")
def op2(spark: SparkSession, d: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that start earlier too."""
    return suffixes.without_repeats(table(spark, d, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op7_token_counts")
def op7(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of every document before and after three edits of it: a replacement, an insertion, a deletion."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    n = F.coalesce(F.length("text"), F.lit(0))
    steps = [(n / 3, 12, F.lit(" revised ")), (n * 2 / 3, 0, F.coalesce("source", F.lit(""))), (n - 5, 5, F.lit(""))]
    edits = F.array(
        *[
            F.struct(F.floor(s).cast("long").alias("start"), F.lit(k).cast("long").alias("length"), x.alias("insert"))
            for s, k, x in steps
        ]
    )
    counted = tokencounts.trees(docs.withColumn("edits", edits), tokenizers.content())
    before = counted.withColumn("n_tokens_before", F.col("n_tokens"))
    after = tokencounts.apply_edits(before, tokenizers.content())
    return after.select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"), "n_reread")


@query("op13_sentencepiece_encode_decode")
def op13(spark: SparkSession, d: str) -> DataFrame:
    """Digests of every text's piece ids, with begin and end, and of the text they decode to."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pieces.digests(docs, pieces.content()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


FINITE = "embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0"
UNITS = "list_transform(embedding, lambda e: floor(1024 * e::double)::bigint)"


def floor_mean(s: str, n: str) -> str:
    return f"((({s}) - ((({s}) % {n}) + {n}) % {n}) // {n})::bigint"


def cluster_rounds(rounds: int) -> str:
    """Common tables c0, c1, ... of centroid components, and n0, n1, ... of each vector's nearest centroid."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""n{r} as materialized (
        select vec_id, arg_min(k, d * 8 + k) k, min(d) d from (
            select vec_id, k, sum((x.a - c.a) * (x.a - c.a))::bigint d from x join c{r} c using (i) group by all) group by vec_id)""")
        if r < rounds:
            out.append(f"""c{r + 1} as materialized (
        select c.k, i, coalesce(m.a, c.a) a from c{r} c left join (
            select k, i, {floor_mean("sum(a)", "count(*)")} a from x join n{r} using (vec_id) group by k, i) m using (k, i))""")
    return ",\n    ".join(out)


@query(
    "op11_centroid_clusters",
    f"""
    with kept as materialized (select vec_id, {UNITS} v from embeddings where {FINITE} and len(embedding) = 64),
    x as materialized (select vec_id, unnest(v) a, generate_subscripts(v, 1) i from kept),
    seeds as (select v, row_number() over (order by sha256('3:' || vec_id), v) - 1 k from kept qualify k < 8),
    c0 as materialized (select k, unnest(v) a, generate_subscripts(v, 1) i from seeds),
    {cluster_rounds(10)}
    select vec_id, k::int as "cluster", d as distance, (sum(d) over (partition by k))::bigint cluster_inertia,
           (sum(d) over ())::bigint inertia, h as centroid_sha256
    from n10 join (select k, sha256(string_agg(a::varchar, ',' order by i)) h from c10 group by k) using (k)
    """,
)
def op11(spark: SparkSession, d: str) -> DataFrame:
    """The centroid of every vector after ten rounds from eight seeds."""
    return centroids.assign(centroids.fit(table(spark, d, "embeddings").select("vec_id", "embedding")))


def code_rounds(rounds: int) -> str:
    """Common tables b0, b1, ... of codebook entries, and n0, n1, ... of each part's nearest entry."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""n{r} as materialized (
        select vec_id, p, arg_min(e, d * 256 + e) e, min(d) d from (
            select vec_id, x.p, e, {' + '.join(f'(x.v[{i}] - b.v[{i}]) * (x.v[{i}] - b.v[{i}])' for i in range(1, 17))} d
            from x join b{r} b using (p)) group by vec_id, p)""")
        if r < rounds:
            means = ", ".join(floor_mean(f"sum(v[{i}])", "count(*)") for i in range(1, 17))
            out.append(f"""b{r + 1} as materialized (
        select b.p, b.e, coalesce(m.v, b.v) v from b{r} b left join (
            select p, e, [{means}] v from x join n{r} using (vec_id, p) group by p, e) m using (p, e))""")
    return ",\n    ".join(out)


@query(
    "op12_vector_codes",
    f"""
    with kept as materialized (select vec_id, "label", {UNITS} v from embeddings where {FINITE}),
    x as materialized (select vec_id, p, v[p * 16 + 1 : p * 16 + 16] v from kept, (select unnest(range(4)) p)),
    firsts as (select vec_id, row_number() over (order by vec_id) - 1 e from kept qualify e < 256),
    b0 as materialized (select p, e, v from x join firsts using (vec_id)),
    {code_rounds(4)},
    coded as (
        select vec_id, string_agg(format('{{:02x}}', e), '' order by p) code, sum(d)::bigint error from n4 group by vec_id),
    digest as (
        select sha256(string_agg(a::varchar, ',' order by p, e, j)) h
        from (select p, e, unnest(v) a, generate_subscripts(v, 1) j from b4))
    select vec_id, code, error, (sum(error) over (partition by "label"))::bigint label_error, h as codebooks_sha256
    from coded join kept using (vec_id), digest
    """,
)
def op12(spark: SparkSession, d: str) -> DataFrame:
    """Four-part codes of every vector after four rounds of the codebooks."""
    found = vectorcodes.fit(table(spark, d, "embeddings").select("vec_id", "embedding", "label"))
    coded = vectorcodes.with_label_error(vectorcodes.encode(found))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.digest(found)).alias("codebooks_sha256"))
