"""Registered queries of the operators and the pipeline, with SQL where it can say the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import bpe, collocations, fingerprint, kneser, langid, license, merkle, packing, partenum, pieces, substring, topk, warc
from shroud.llm.storage import shared_path, small_batches, stored
from shroud.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return run
    return add


@register("""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     m AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.first <> p.page_id THEN m.first END AS refers_to, true AS verified
FROM p LEFT JOIN m ON p.d = m.d AND p.n >= 1000""")
def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as WARC and read back; ``verified``: whole, with the digest its header names, a revisit with the response it names."""
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    back = warc.reassemble(warc.read_records(spark, path))
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("digest"))
    back = stored(back.withColumn("payload_digest", digest).drop("payload"), "warc-records")
    return warc.checked(back).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                     F.regexp_extract("refers_to", r"^<urn:page:(-?\d+):", 1).cast("long").alias("refers_to"), "verified")


@register()
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, and the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


@register()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(stored(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


@register()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(langid.train_rows(docs))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@register("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
           FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one, by integer inner product."""
    vectors = topk.scaled(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
     n AS (SELECT doc_id, words, len(words) AS n FROM w),
     g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s FROM n, unnest(generate_series(1, n - 12)) AS t(i)),
     l AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
     c AS (SELECT DISTINCT g.doc_id, g.i + k AS i FROM g JOIN l USING (s), unnest(generate_series(0, 12)) AS t(k) WHERE l.first < g.doc_id),
     x AS (SELECT n.doc_id, t.i, n.words[t.i] AS word FROM n, unnest(generate_series(1, n)) AS t(i)),
     k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_words, CAST(n.n - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)"""


@register(OP6_SQL)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat 13 or more words of an earlier one are removed."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
     g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM w, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS t(i) WHERE len(words) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
     e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
     r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) l ON l.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""


@register(OP10_SQL)
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by sharing at least 80 percent of their five-word shingles, as components."""
    return partenum.similar_components(table(spark, sf_dir, "documents", "doc_id", "text"))


@register()
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-sensitive fingerprints of every text, its edit, and how near they are."""
    out = fingerprint.with_edit(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@register()
def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the trusted ones, and whether it is kept."""
    return kneser.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


@register()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document, by alignment with the known templates."""
    return license.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


@register()
def op11_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text with the end id, and the text decoded from them."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = pieces.decode(pieces.encode(docs, path).drop("text"), path)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def _op12_sql(levels: int = 6, source_levels: int = 3) -> str:
    """Level by level: enough for 16 ** levels rows a source and 16 ** source_levels sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""
    parts = [f"""d AS (SELECT doc_id, source, sha256({head} || {field("text")}) AS h, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field(lower)}) END AS bad FROM documents),
         l0 AS (SELECT source, doc_id, bad, h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)"""]
    run = """coalesce(string_agg(h, '') OVER (PARTITION BY {k}i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
             coalesce(string_agg(h, '') OVER (PARTITION BY {k}i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after"""

    def tree(name: str, key: str, n: int) -> None:
        for k in range(n):
            by = f"{key}, " if key else ""
            parts.append(f"{name}w{k} AS (SELECT *, {run.format(k=by)} FROM {name}{k} WHERE n > 1)")
            over = f"PARTITION BY {key}" if key else ""
            parts.append(f"""{name}{k + 1} AS (SELECT *, count(*) OVER ({over}) AS n FROM
                (SELECT {by}i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > 1 GROUP BY {by}i // 16))""")

    tree("l", "source", levels)
    parts.append("s AS (" + " UNION ALL ".join(f"SELECT source, h FROM l{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    parts.append("t0 AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM s)")
    tree("t", "", source_levels)
    parts.append("r AS (" + " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(source_levels + 1)) + ")")
    parts.append("f0 AS (SELECT doc_id, source, h AS leaf, coalesce(bad, h) AS f, i, '' AS proof FROM l0)")
    step = "CASE WHEN w.i IS NULL THEN p.f ELSE sha256(w.before || p.f || w.after) END AS f, p.i // 16 AS i, p.proof || coalesce(w.before || w.after, '') AS proof"
    for k in range(levels):
        parts.append(f"f{k + 1} AS (SELECT p.doc_id, p.source, p.leaf, {step} FROM f{k} p LEFT JOIN lw{k} w ON w.source IS NOT DISTINCT FROM p.source AND w.i = p.i)")
    parts.append(f"g0 AS (SELECT p.doc_id, p.leaf, t0.h AS subroot, p.f, t0.i, p.proof FROM f{levels} p JOIN t0 ON t0.source IS NOT DISTINCT FROM p.source)")
    for k in range(source_levels):
        parts.append(f"g{k + 1} AS (SELECT p.doc_id, p.leaf, p.subroot, {step} FROM g{k} p LEFT JOIN tw{k} w ON w.i = p.i)")
    return "WITH " + ",\n".join(parts) + f" SELECT g.doc_id, g.leaf, g.subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.f AS folded_root, g.f = r.h AS verified FROM g{source_levels} g, r"


@register(_op12_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, proof and check of every document in a Merkle tree per source and over the sources."""
    out = merkle.manifest(table(spark, sf_dir, "documents", *merkle.FIELDS))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
     q AS (SELECT lang, w FROM p WHERE len(w) > 0),
     t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM q GROUP BY lang),
     g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM q, unnest([1, 2, 3]) AS s(k), unnest(generate_series(1, len(w) - k + 1)) AS u(i)),
     f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM g GROUP BY lang, k, phrase),
     c AS (SELECT lang, k, phrase, w, f AS a FROM f WHERE k > 1 AND f >= 10),
     x AS (SELECT c.*, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score FROM c, unnest(generate_series(1, k - 1)) AS u(cut)
           JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')),
     b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
     i AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3) GROUP BY lang, phrase),
     y AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE i.a IS NULL OR 100 * i.a < 50 * b.a),
     z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y)
SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, t.n, CAST(z.score AS BIGINT) AS score FROM z JOIN t USING (lang) WHERE z.rank <= 2000"""


@register(OP13_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of two and three words that occur together most, by language."""
    return collocations.mine(table(spark, sf_dir, "documents", "text", "lang"))
