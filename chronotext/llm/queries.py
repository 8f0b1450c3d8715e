"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from chronotext.llm import bpe, collocations, embeddings, licenses, minhash, mixing, packing, periodic, secrets, substrings, topk, toxicity, urls
from chronotext.llm.common import inline, table

#: (host, path, verdict)
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_minhash_near_duplicates(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op2_exact_top_k(spark, folder):
    return topk.exact_top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_license_scan(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"), licenses.known_digests(spark))


def op4_url_filter(spark, folder):
    listed = inline(spark, ["host", "path", "verdict"], URL_RULES)
    return urls.filter_urls(table(spark, folder, "pages"), listed)


def op5_embedding_near_duplicates(spark, folder):
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op6_bpe_round_trip(spark, folder):
    return bpe.round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, folder, "labels")))


def op8_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


def op9_substring_dedup(spark, folder):
    return substrings.repeated_passages(table(spark, folder, "documents"))


def op10_secret_scan(spark, folder):
    return secrets.scan_secrets(table(spark, folder, "documents"))


def op11_phrase_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


def plant_periods(docs):
    """(doc_id, text): texts whose id has a checksum that ends in 0 go on with a period from some word on."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    check = F.crc32(F.col("doc_id").cast("string"))
    planted = F.array_join(
        F.expr("concat(slice(w, 1, int(a)), transform(sequence(a, n - 1), i -> w[int(a + (i - a) % p)]))"), " "
    )
    chosen = docs.where((check % 10 == 0) & F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    sized = chosen.select("doc_id", words.alias("w"), F.floor(check / 10).alias("g"))
    sized = sized.withColumn("n", F.size("w").cast("long")).withColumn("a", F.expr("g % n"))
    sized = sized.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    rest = docs.where(~F.coalesce((check % 10 == 0) & F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return sized.select("doc_id", planted.alias("text")).unionByName(rest.select("doc_id", "text"))


def op12_periodic_runs(spark, folder):
    found = periodic.periodic_runs(plant_periods(table(spark, folder, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = periodic.longest_run("runs")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_context_mixing(spark, folder):
    return mixing.score_texts(table(spark, folder, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_minhash_near_duplicates, op2_exact_top_k, op3_license_scan, op4_url_filter, op5_embedding_near_duplicates,
        op6_bpe_round_trip, op7_toxicity, op8_packing, op9_substring_dedup, op10_secret_scan, op11_phrase_collocations, op12_periodic_runs, op13_context_mixing,
    )
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def _canonical_sql(text: str) -> str:
    copyright_line = licenses.COPYRIGHT_LINE.replace("'", "''")
    out = f"regexp_replace(lower({text}), '{licenses.MARK}', chr({ord(licenses.SIGN)}) || '\\1', 'g')"
    out = f"regexp_replace({out}, '{copyright_line}', '\\1', 'g')"
    out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for _, pattern, to in licenses.SPELLINGS:
        to = to.replace("{", "\\").replace("}", "")
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"sha256({out})"


_KNOWN = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in licenses.KNOWN)

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of the digits of an id, bit by bit: -1 is a shift, other items are bytes.
_CHECKSUM = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END))"""

ORACLE = {
    "op1_minhash_near_duplicates": f"""
        WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
                       FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
                 FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
                  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots USING (doc_id)""",
    "op9_substring_dedup": f"""
        WITH words AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x
                    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
        gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY doc_id),
        alone AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words)),
        left_ AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM alone a
                  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(g) AS q FROM gone) x WHERE x.doc_id = a.doc_id AND x.q = a.p)
                  GROUP BY a.doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM words LEFT JOIN gone USING (doc_id) LEFT JOIN left_ USING (doc_id)""",
    "op2_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS u
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
                     CAST(list_sum(list_transform(list_zip(q.u, d.u), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, vec_id, score,
                     row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_license_scan": f"""
        WITH known AS (SELECT {_canonical_sql("body")} AS digest, min(license) AS license
                       FROM (VALUES {_KNOWN}) k(license, body) GROUP BY 1),
        lines AS (SELECT doc_id, {_canonical_sql("line")} AS digest
                  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
        notices AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
                    FROM lines JOIN known USING (digest) GROUP BY doc_id),
        whole AS (SELECT doc_id, {_canonical_sql("text")} AS digest FROM documents)
        SELECT doc_id, digest, license, coalesce(notices, '') AS notices
        FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (doc_id)""",
    "op4_url_filter": f"""
        WITH rules AS (SELECT * FROM (VALUES {_RULES}) r(h, p, v)),
        cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
                FROM pages),
        parts AS (SELECT row_number() OVER () AS n, page_id,
                         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut),
        fits AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
                 FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)""",
    "op5_embedding_near_duplicates": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM roots LEFT JOIN counts USING (vec_id)""",
    "op11_phrase_collocations": f"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
        grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
                  FROM words, range(1, 6) t(k)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
        n AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
        longer AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(f) AS f
                   FROM f, range(2, 5) s(m), range(1, 5) t(i) WHERE k > m AND i + m - 1 <= k GROUP BY ALL),
        cuts AS (SELECT c.lang, c.phrase, c.f AS a, i, array_to_string(string_split(c.phrase, ' ')[:i], ' ') AS first,
                        array_to_string(string_split(c.phrase, ' ')[i + 1:], ' ') AS rest
                 FROM f c LEFT JOIN longer USING (lang, phrase), range(1, 5) t(i)
                 WHERE c.k > 1 AND i < c.k AND coalesce(100 * longer.f < 100 * c.f, true)),
        scored AS (SELECT cuts.lang, cuts.phrase, i, a, x.f AS l, y.f AS r, n,
                          CAST(1000 AS HUGEINT) * a * CAST(n AS HUGEINT) // (CAST(x.f AS HUGEINT) * y.f) AS score
                   FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
                   JOIN n ON n.lang = cuts.lang),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS place FROM scored),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE place = 1)
        SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
               CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
    "op12_periodic_runs": f"""
        WITH texts AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS v, {_CHECKSUM} AS h FROM documents),
        sized AS (SELECT *, len(v) AS n, CASE WHEN h % 10 = 0 AND len(v) > 0 THEN (h // 10) % len(v) END AS a FROM texts),
        planted AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized),
        docs AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN v ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN v[i + 1] ELSE v[a + (i - a) % p + 1] END) END AS w
                 FROM planted),
        words AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM docs),
        -- Stretches of places whose words a period on are the same.
        pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y
                  ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 2 * (y.i - x.i) <= x.n),
        ranked AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM pairs),
        long AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM ranked GROUP BY doc_id, q, stretch
                 HAVING count(*) >= q AND count(*) + q >= 12),
        runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM long GROUP BY ALL),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS place FROM runs) WHERE place = 1),
        digests AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS d
                    FROM runs GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS d FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
               coalesce(digests.d, sha256('')) AS runs_sha256, coalesce(kept.d, sha256('')) AS collapsed_sha256
        FROM docs LEFT JOIN best USING (doc_id) LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
