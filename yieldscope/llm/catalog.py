"""Queries over the given tables, one for each operator, with SQL counterparts where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldscope.llm import decontaminate, jaccard, langid, pieces, privacy, repair, ring, secret_scan, suffixes, token_file, topk, toxicity, trie
from yieldscope.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the equivalent the results are compared with."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WORDS_7 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op7_decontaminate", rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS_7}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS_7} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS win
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (
    SELECT p.doc_id, p.i, p.n, x.item_id FROM (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM places) p
    JOIN windows x ON x.win = p.win),
covered AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Hit words and items of every document."""
    found = decontaminate.decontaminate(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"), [F.col("doc_id")])
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda s, r: s + r.end - r.first)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.size("runs") > 0).alias("contaminated"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents by a model of the labelled rows that are not held out."""
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(documents, labels.where(~held_out))
    scored = toxicity.score(documents, [F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out")], model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op9_ring_shards")
def op9_ring_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All documents on 16 shards of equal row counts."""
    return (ring.shard(table(spark, sf, "documents"), shards=16)
            .withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int")))


@query("op2_bit_sliced_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10""")
def op2_bit_sliced_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best rows of every hundredth vector."""
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_blocks")
def op6_token_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents' ids written in blocks and read back."""
    path = token_file.scratch_file(spark)
    token_file.write(table(spark, sf, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_file.read(spark, path, digest=True)


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document, as a number and a checksum, and whether decoding gives the text again."""
    return pieces.encode(table(spark, sf, "documents"), [F.col("doc_id")], vocabulary("piece_bpe_32k.model"), digest=True)


@query("op5_jaccard_join", r"""
WITH RECURSIVE w AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, w[i:i + least(4, len(w)) - 1] AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(y) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) JOIN reach ON x = w.doc_id GROUP BY ALL""")
def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose four-word shingles overlap by 85 %."""
    return jaccard.near_duplicates(table(spark, sf, "documents"), size=4, percent=85)


@query("op3_suffix_repeats", """
WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
blocks AS (SELECT doc_id, n, z, substr(h, 2000 * z + 1, 2800) AS part
           FROM (SELECT doc_id, h, n, unnest(range((n - 400) // 1000 + 1)) AS z FROM b WHERE n >= 400)),
w AS (SELECT doc_id, 1000 * z + j AS i, md5(substr(part, 2 * j + 1, 800)) AS k
      FROM (SELECT doc_id, z, part, unnest(range(least(1000, n - 399 - 1000 * z))) AS j FROM blocks)),
hits AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, i > 400 + coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS fresh FROM hits),
runs AS (
    SELECT doc_id, min(i) AS a, max(i) + 400 AS e
    FROM (SELECT doc_id, i, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS left_over, sum(e - a) AS gone, count(*) - 1 AS spans
    FROM (SELECT r.doc_id, h, a, e, coalesce(lag(e) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS f
          FROM (FROM runs UNION ALL SELECT doc_id, n, n FROM b) r JOIN b USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, gone::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(left_over)) AS kept_sha256
FROM b JOIN kept USING (doc_id)""")
def op3_suffix_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the strings of 400 bytes that also start elsewhere."""
    found = suffixes.remove_repeats(table(spark, sf, "documents"), length=400)
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x.end - x.first)
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                        F.col("kept").alias("kept_sha256"))


def _spans_sql(kind: str, pattern: str, good: str) -> str:
    """Checked spans of a kind: the gaps and the matches of a text, laid end to end."""
    return f"""
    SELECT r, doc_id, '{kind}' AS kind, s AS start, s + length(hit) AS fin, lower(hit) AS value FROM (
        SELECT *, (length(gap) + coalesce(sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s
        FROM (SELECT r, doc_id, unnest(range(len(m))) AS i, unnest(m) AS hit, unnest(g[:len(m)]) AS gap
              FROM (SELECT r, doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d)))
    WHERE {good}"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = (f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse({_DIGITS}), i + 1, 1)::INT "
         f"ELSE (2 * substr(reverse({_DIGITS}), i + 1, 1)::INT) % 10 + (2 * substr(reverse({_DIGITS}), i + 1, 1)::INT) // 10 END)) % 10 = 0")
_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED (
    {_spans_sql("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "true")} UNION ALL
    {_spans_sql("ip", "[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)",
                "len(list_filter(string_split(hit, '.'), lambda x: x::HUGEINT > 255)) = 0")} UNION ALL
    {_spans_sql("card", "[0-9]([ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")} UNION ALL
    {_spans_sql("phone", "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15")}),
m AS (
    SELECT b.r, kind || ':' || value AS entity, greatest(start - 120, 0) AS f, least(fin + 120, length(text)) AS t, length(text) AS n,
           substr(text, greatest(start - 120, 0) + 1, least(fin + 120, length(text)) - greatest(start - 120, 0)) AS c
    FROM base b JOIN d USING (r)),
cut AS (SELECT *, row_number() OVER () AS k, regexp_extract_all(c, '\p{{L}}[\p{{L}}\p{{N}}''-]{{2,}}') AS w,
               string_split_regex(c, '\p{{L}}[\p{{L}}\p{{N}}''-]{{2,}}') AS g FROM m),
placed AS (
    SELECT *, f + length(gap) + coalesce(sum(length(gap) + length(hit)) OVER (PARTITION BY k ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
    FROM (SELECT r, k, entity, f, t, n, unnest(range(len(w))) AS i, unnest(w) AS hit, unnest(g[:len(w)]) AS gap FROM cut)),
words AS MATERIALIZED (
    SELECT r, entity, s::BIGINT AS start, (s + length(hit))::BIGINT AS fin, lower(hit) AS term FROM placed p
    WHERE (s > f OR f = 0) AND (s + length(hit) < t OR t = n)
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = p.r AND b.start < p.s + length(p.hit) AND p.s < b.fin)),
joint AS (SELECT entity, term, count(DISTINCT r) AS n_et FROM words GROUP BY ALL),
ent AS (SELECT kind || ':' || value AS entity, count(DISTINCT r) AS n_e FROM base GROUP BY ALL),
df AS (SELECT term, count(*) AS n_t FROM (
           SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\p{{L}}[\p{{L}}\p{{N}}''-]{{2,}}'))) AS term FROM d) GROUP BY ALL),
revealing AS (
    SELECT entity, term FROM joint JOIN ent USING (entity) JOIN df USING (term), (SELECT count(*) AS total FROM d)
    WHERE n_e < total AND (n_et + 0.5 * n_e / total) / (n_t + 0.5) >= (n_e / total) ** 0.25),
spans AS (
    SELECT r, kind, start, fin FROM base UNION ALL
    SELECT DISTINCT r, 'term', start, fin FROM words JOIN revealing USING (entity, term)),
listed AS (
    SELECT r, coalesce(string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY kinds.o, start) FILTER (kind <> 'term'), '') AS b,
           string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY kinds.o, start) AS a
    FROM spans JOIN (VALUES ('email', 1), ('ip', 2), ('card', 3), ('phone', 4), ('term', 5)) kinds(kind, o) USING (kind) GROUP BY r),
counts AS (SELECT r, count(*) FILTER (kind = 'email') AS e, count(*) FILTER (kind = 'ip') AS i, count(*) FILTER (kind = 'card') AS c,
                  count(*) FILTER (kind = 'phone') AS p FROM base GROUP BY r)
SELECT doc_id, coalesce(e, 0)::BIGINT AS n_email, coalesce(i, 0)::BIGINT AS n_ip, coalesce(c, 0)::BIGINT AS n_card,
       coalesce(p, 0)::BIGINT AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN counts USING (r) LEFT JOIN listed USING (r)"""


@query("op1_private_terms", _OP1)
def op1_private_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document, and the terms near it that disclose it."""
    found = privacy.disclosures(table(spark, sf, "documents"), keep_text=False)
    terms = F.transform("terms", lambda t: F.struct(
        F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["term"].alias("value")))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in privacy.KINDS],
                        F.sha2(privacy.listed(F.col("base")), 256).alias("base_sha256"),
                        privacy.listed(F.concat("base", terms)).alias("spans"))


@query("op4_secret_forest")
def op4_secret_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document: how many of the candidates, where, and the cleaned text's checksum."""
    documents, dictionary = table(spark, sf, "documents"), vocabulary("word_bpe_49k.json")
    found = secret_scan.scan(documents, [F.col("doc_id")], *secret_scan.fitted(documents, dictionary), dictionary)
    spans = F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("bigint").alias("n_secrets"),
                        F.concat_ws(",", spans).alias("spans"), F.crc32("clean").alias("clean_crc32"))


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    return (f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), "
            "lambda c, b: list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), "
            "4294967295::BIGINT), 4294967295)")


@query("op11_prefix_trie", f"""
WITH t AS MATERIALIZED (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS pos, r, x
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
    SELECT c.conv_id, 0 AS part, b.pos, b.r, b.x FROM c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 100 AND b.pos <= h UNION ALL
    SELECT conv_id, 1, pos, r, x FROM t JOIN c USING (conv_id) WHERE pos > h),
whole AS (
    SELECT conv_id, coalesce(w, []) AS w, coalesce(n, []) AS n FROM c LEFT JOIN (
        SELECT conv_id, list(length(r) || ':' || r || x ORDER BY part, pos) AS w, list(length(x) ORDER BY part, pos) AS n
        FROM rebuilt GROUP BY conv_id) USING (conv_id)),
p AS MATERIALIZED (
    SELECT conv_id, i AS depth, w[:i] AS node, w[:i - 1] AS up, i = len(w) AS ends, CASE WHEN i > 0 THEN n[i] ELSE 0 END AS chars
    FROM (SELECT *, unnest(range(len(w) + 1)) AS i FROM whole)),
nodes AS MATERIALIZED (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(chars) AS chars,
           string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS enders FROM p GROUP BY node, depth),
kids AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node, depth)),
sums AS (
    SELECT a.node, a.depth, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * u.chars) AS saved_tokens
    FROM counted u JOIN p a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY ALL)
SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(v.enders, '')) AS ends_sha256
FROM counted v JOIN sums USING (node, depth) LEFT JOIN nodes o ON v.depth > 0 AND o.node = v.up AND o.depth = v.depth - 1""")
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The trie of all conversations, their openings shared within each hundred."""
    conversations = table(spark, sf, "conversations")
    turns = trie.ordered_turns(conversations, scratch_path(spark, "turns"))
    return trie.prefix_trie(trie.share_openings(turns), conversations)


def _row_costs(c: list[str]) -> str:
    """Costs to go before a row from those behind it, for the four states."""
    keep = lambda q, initial, to: f"CASE WHEN NOT must THEN CASE WHEN f.initial = '{initial}' THEN 0 ELSE 2 END + cut + {c[to]} ELSE 99999999 END"
    system = f"CASE WHEN NOT must AND f.initial = 's' THEN cut + {c[1]} ELSE 99999999 END"
    own = [f"least(3 + {c[0]}, {keep(0, 'u', 2)}, {system})", f"least(3 + {c[1]}, {keep(1, 'u', 2)})",
           f"least(3 + {c[2]}, {keep(2, 'a', 3)})", f"least(3 + {c[3]}, {keep(3, 'u', 2)})"]
    two, three = f"least({own[2]}, 2 + {own[3]})", f"least({own[3]}, 2 + {own[2]})"
    return f"[least({own[0]}, 2 + {two}), least({own[1]}, 2 + {two}), {two}, {three}]"


@query("op13_structure_repair", f"""
WITH RECURSIVE damaged AS (
    SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
           CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
    FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {crc_sql("(conv_id::VARCHAR || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, substr(role, 1, 1) AS initial FROM damaged),
f AS MATERIALIZED (
    SELECT *, NOT blank AND again AS duplicate, blank OR again AS must, (NOT blank AND NOT again AND cut_off)::INT AS cut FROM (
        SELECT *, core = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
               right(core, 1) NOT IN ('.', '!', '?') AS cut_off, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o)),
back AS (
    SELECT conv_id, max(i) + 1 AS i, [0, 4, 2, 0] AS b FROM f GROUP BY conv_id UNION ALL
    SELECT f.conv_id, f.i, {_row_costs(["b[1]", "b[2]", "b[3]", "b[4]"])} FROM back JOIN f ON f.conv_id = back.conv_id AND f.i = back.i - 1),
steps AS MATERIALIZED (
    SELECT back.conv_id, back.i, back.b, next.b AS c, role, text, initial, must, cut
    FROM back LEFT JOIN back next ON next.conv_id = back.conv_id AND next.i = back.i + 1
    LEFT JOIN f ON f.conv_id = back.conv_id AND f.i = back.i),
walk AS (
    SELECT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS out FROM (SELECT DISTINCT conv_id FROM f) UNION ALL
    SELECT conv_id, i + (letter <> 'I')::INT, CASE letter WHEN 'D' THEN q WHEN 'K' THEN held ELSE due END, audit || letter,
           CASE letter WHEN 'D' THEN out WHEN 'I' THEN list_append(out, called || ':') WHEN 'K' THEN list_append(out, role || ':' || text)
                ELSE list_append(out, called || ':' || text) END
    FROM (SELECT *, CASE WHEN c IS NOT NULL AND 3 + c[q] = b[q] THEN 'D' WHEN 2 + b[due] = b[q] THEN 'I' WHEN c IS NULL THEN NULL
                         WHEN NOT must AND held IS NOT NULL AND cut + c[held] = b[q] THEN 'K' ELSE 'R' END AS letter
          FROM (SELECT walk.*, s.b, s.c, s.role, s.text, s.must, s.cut, CASE q WHEN 3 THEN 4 ELSE 3 END AS due,
                       CASE q WHEN 3 THEN 'assistant' ELSE 'user' END AS called,
                       CASE WHEN initial = 's' AND q = 1 THEN 2 WHEN initial = 'u' AND q <> 3 THEN 3 WHEN initial = 'a' AND q = 3 THEN 4 END AS held
                FROM walk JOIN steps s ON s.conv_id = walk.conv_id AND s.i = walk.i))
    WHERE letter IS NOT NULL),
ended AS (SELECT conv_id, max_by(audit, length(audit)) AS audit, max_by(out, length(audit)) AS out FROM walk GROUP BY conv_id),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
           count(*) FILTER (duplicate) AS duplicate, sum(cut) AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b[1], 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) LEFT JOIN counts USING (conv_id) LEFT JOIN ended USING (conv_id)
LEFT JOIN (SELECT conv_id, b FROM back WHERE i = 1) USING (conv_id)""")
def op13_structure_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation's faults and cheapest repair, after damage by a fixed rule."""
    conversations = table(spark, sf, "conversations")
    return repair.repair(repair.damaged(conversations), conversations)


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of all documents by a network of the rows that are not held out."""
    documents = table(spark, sf, "documents")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    net = langid.train(documents.where(rest != 1))
    return langid.predict(documents, [F.col("doc_id"), F.coalesce(rest == 1, F.lit(False)).alias("held_out")], net)
