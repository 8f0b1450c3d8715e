"""The registered queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

from chronotext.functions import text as tx
from chronotext.operators.gaps import PAIRS_PER_GAP, YEAR_GAPS
from chronotext.plans.catalog import LETTERS


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def _information(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 THEN 0.0 WHEN {b} = 0 THEN 'inf'::DOUBLE ELSE {a} * ln({a} / {b}) END"


def _kl(p: str, q: str) -> str:
    return f"list_sum(list_transform(list_zip({p}, {q}), lambda z: {_information('z[1]', 'z[2]')}))"


def _js(p: str, q: str) -> str:
    middle = "((z[1] + z[2]) / 2)"
    both = f"({_information('z[1]', middle)}) / 2 + ({_information('z[2]', middle)}) / 2"
    return f"list_sum(list_transform(list_zip({p}, {q}), lambda z: {both}))"


LETTER_TOKENS = "regexp_extract_all(lower(text), '[a-z][''a-z]*')"
WORD_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
YEAR = "(1650 + (doc_id * 7) % 300)"
HEAD_LINE = "split_part(text, chr(10), 1)"


def _slug(title: str) -> str:
    return f"lower(regexp_replace({title}, '[^A-Za-z0-9_]+', '', 'g'))"


def _flat(text: str) -> str:
    return rf"regexp_replace({text}, '[\r\n\t]+', ' ', 'g')"


ARTICLES = f"""articles AS (
  SELECT doc_id, lang, concat(substr(text, 1, CAST(floor(length(text) / 2) AS INT)), ' ', CAST({YEAR} AS VARCHAR), ' ',
         substr(text, CAST(floor(length(text) / 2) AS INT) + 1)) AS text
  FROM documents)"""

_TITLE = f"replace({HEAD_LINE}, chr(9), ' ')"
LINES = f"""lines AS (
  SELECT doc_id, concat({_slug(_TITLE)}, chr(9), {_TITLE}, chr(9),
    CASE lang WHEN 'fr' THEN '' WHEN 'de' THEN concat({_flat('text')}, chr(9), 'extra')
              WHEN 'es' THEN concat({_flat('text')}, chr(9), chr(9)) ELSE {_flat('text')} END) AS value
  FROM documents)"""
FIELDS = r"""fields AS (
  SELECT doc_id, value, CASE WHEN regexp_full_match(value, '\t+') THEN []::VARCHAR[]
    ELSE string_split(regexp_replace(value, '\t+$', ''), chr(9)) END AS f
  FROM lines)"""

YEAR_TEXTS = f"""year_texts AS (
  SELECT doc_id, CASE lang WHEN 'es' THEN 'xxxx' WHEN 'de' THEN concat('c.', CAST({YEAR} AS VARCHAR))
                 ELSE CAST({YEAR} AS VARCHAR) END AS year, text
  FROM documents)"""

PAGES = r"""web AS (
  SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
    regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS content
  FROM pages)"""

VOCABULARY = f"""counts AS (
  SELECT token, count(*) AS n FROM (SELECT unnest({LETTER_TOKENS}) AS token FROM documents)
  WHERE token NOT IN ({_quoted(tx.VOCABULARY_STOPWORDS)}) GROUP BY token),
vocab AS (SELECT row_number() OVER (ORDER BY n DESC, token) - 1 AS idx, token, n FROM counts)"""

VECTORS = """sizes AS (
  SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings),
thetas AS (
  SELECT vec_id AS id, CAST(1700 + vec_id % 212 AS INT) AS year,
         list_transform(a, lambda x: x / list_sum(a)) AS theta FROM sizes)"""


def _initials(name: str, source: str, id_column: str, text: str) -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE initial = '{c}') / count(*)" for c in LETTERS)
    tokens = LETTER_TOKENS.replace("text", text)
    return f"""{name} AS (
  SELECT id, CAST(1700 + id % 212 AS INT) AS year, [{cells}] AS theta FROM (
    SELECT {id_column} AS id, left(unnest({tokens}), 1) AS initial FROM {source}) GROUP BY id)"""


CELLS = f"""term_counts AS (
  SELECT lang, CAST(doc_id % 10 AS INT) AS time_idx, term, count(*) AS n
  FROM (SELECT lang, doc_id, unnest({LETTER_TOKENS}) AS term FROM documents) GROUP BY ALL),
cells AS (
  SELECT lang AS topic, time_idx, term, ln(n / sum(n) OVER (PARTITION BY lang, time_idx)) AS logp FROM term_counts)"""


def _ranked(direction: str) -> str:
    return f"""ranked AS (
  SELECT topic, 1800 + time_idx AS year, place, term, logp FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY topic, time_idx ORDER BY logp {direction}, term) AS INT) AS place
    FROM cells) WHERE place <= 10)"""


SOURCES = f"""source_counts AS (
  SELECT token, topic, CAST(count(*) AS INT) AS n FROM (
    SELECT CAST(regexp_extract(source, '[0-9]+') AS INT) AS topic, unnest({LETTER_TOKENS}) AS token FROM documents)
  GROUP BY ALL)"""

UNPACKED = """placed AS (
  SELECT token AS type, CASE WHEN n % 7 = 0 THEN 0 ELSE (n << 5) | topic END AS value,
         row_number() OVER (PARTITION BY token ORDER BY n DESC, topic) AS place FROM source_counts),
stops AS (SELECT type, min(place) FILTER (WHERE value <= 0) AS stop FROM placed GROUP BY type),
unpacked AS (
  SELECT type, CAST(value & 31 AS INT) AS topic, CAST(value >> 5 AS INT) AS n
  FROM placed JOIN stops USING (type) WHERE stop IS NULL OR place < stop)"""

PAIR_LINES = f"""year_means AS (
  SELECT year, list(m ORDER BY pos) AS theta FROM (
    SELECT year, pos, avg(v) AS m FROM (
      SELECT year, unnest(range(len(theta))) AS pos, unnest(theta) AS v FROM thetas) GROUP BY ALL)
  GROUP BY year),
pair_lines AS (
  SELECT printf('%d-%d,%.12f', a.year, b.year, {_js('a.theta', 'b.theta')}) AS value
  FROM year_means a JOIN year_means b ON a.year < b.year)"""

TOPIC_COUNT, ROUNDS = 10, 3


def _topic_words(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({WORD_TOKENS}) AS token FROM {source})
  WHERE token NOT IN ({_quoted(tx.TOPIC_STOPWORDS)}) AND NOT regexp_full_match(token, '[0-9]+') GROUP BY ALL)"""


def _topic_shares(name: str, mass: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT token, k, (mass + 0.01) / (sum(mass) OVER (PARTITION BY k) + 0.01 * (SELECT count(*) FROM ranked)) AS share
  FROM {mass})"""


def _topic_round(prefix: str, words_: str, shares: str, n: int, prior: str, rest: bool = False) -> list[str]:
    """Round ``n``, from 1, of a set of documents: the dealt counts and then the topics of its documents.

    With ``rest`` only the documents go on that moved in the round before.
    """
    theta = "" if n == 1 else f"JOIN {prefix}_theta{n - 1} USING (doc_id, k)"
    if rest and n > 2:
        theta += f" JOIN {prefix}_moving{n - 1} USING (doc_id)"
    p = "share" if n == 1 else "share * theta"
    return [
        f"""{prefix}_dealt{n} AS MATERIALIZED (
  SELECT doc_id, token, k, n * p / sum(p) OVER (PARTITION BY doc_id, token) AS m
  FROM (SELECT doc_id, token, k, n, {p} AS p FROM {words_} JOIN {shares} USING (token) {theta}))""",
        f"""{prefix}_theta{n} AS MATERIALIZED (
  SELECT doc_id, k, (sum(m) + any_value(alpha)) / (sum(sum(m)) OVER (PARTITION BY doc_id) + 1.0) AS theta
  FROM {prefix}_dealt{n} JOIN {prior} USING (k) GROUP BY doc_id, k)""",
    ]


def _topic_model(source: str) -> list[str]:
    """The words of the documents, and their mass after the last round as ``mass``."""
    parts = [
        _topic_words("words_", source),
        """ranked AS MATERIALIZED (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS idx
  FROM (SELECT token, CAST(sum(n) AS BIGINT) AS n FROM words_ GROUP BY token))""",
        f"""mass0 AS MATERIALIZED (
  SELECT token, k, n * (0.1::DOUBLE + ((idx % 10007 + 1) * (2 * k + 1) * 7919 % 10007)::DOUBLE / 10007) AS mass
  FROM ranked, range({TOPIC_COUNT}) topics(k))""",
        f"prior0 AS MATERIALIZED (SELECT k, 1.0::DOUBLE / {TOPIC_COUNT} AS alpha FROM range({TOPIC_COUNT}) topics(k))",
    ]
    for n in range(1, ROUNDS + 1):
        parts += [_topic_shares(f"share{n}", f"mass{n - 1}"), *_topic_round("fit", "words_", f"share{n}", n, f"prior{n - 1}")]
        parts.append(f"prior{n} AS MATERIALIZED (SELECT k, avg(theta) AS alpha FROM fit_theta{n} GROUP BY k)")
        parts.append(f"mass{n} AS MATERIALIZED (SELECT token, k, sum(m) AS mass FROM fit_dealt{n} GROUP BY token, k)")
    return parts


def _topic_thetas(prefix: str, source: str) -> list[str]:
    """(id, year, theta) of documents whose words the model knows, as ``prefix``."""
    parts = [_topic_words(f"{prefix}_words", source)]
    for n in range(1, ROUNDS + 1):
        parts += _topic_round(prefix, f"{prefix}_words", "share", n, f"prior{ROUNDS - 1}", rest=True)
        if n > 1:
            parts.append(f"""{prefix}_moving{n} AS MATERIALIZED (
  SELECT doc_id FROM {prefix}_theta{n} a JOIN {prefix}_theta{n - 1} b USING (doc_id, k)
  GROUP BY doc_id HAVING max(abs(a.theta - b.theta)) > 1e-4)""")
    # A document has the shares of its last round.
    last = " UNION ALL ".join(
        f"SELECT * FROM {prefix}_theta{n}" + (f" ANTI JOIN {prefix}_theta{n + 1} USING (doc_id)" if n < ROUNDS else "") for n in range(1, ROUNDS + 1)
    )
    parts.append(f"""{prefix} AS MATERIALIZED (
  SELECT doc_id AS id, any_value(year) AS year, list(round(theta, 6) ORDER BY k) AS theta
  FROM ({last}) JOIN {source} USING (doc_id) GROUP BY doc_id)""")
    return parts


ORACLE: dict[str, str] = {
    "word_count": f"SELECT token, count(*) AS n FROM (SELECT unnest({WORD_TOKENS}) AS token FROM documents) GROUP BY token",
    "dtm_token_counts": _with(VOCABULARY) + " SELECT token, n FROM counts",
    "lda_token_counts": f"""SELECT token, count(*) AS n FROM (SELECT unnest({WORD_TOKENS}) AS token FROM documents)
        WHERE token NOT IN ({_quoted(tx.TOPIC_STOPWORDS)}) AND NOT regexp_full_match(token, '[0-9]+') GROUP BY token""",
    "strict_tsv_parse": _with(LINES, FIELDS)
    + " SELECT doc_id, f[1] AS slug, f[2] AS title, f[3] AS text FROM fields WHERE len(f) = 3",
    "year_text_lines": _with(LINES, FIELDS)
    + " SELECT doc_id, f[1] AS year, f[2] AS text FROM fields WHERE len(f) >= 2",
    "year_range_docs": _with(YEAR_TEXTS)
    + """ SELECT doc_id, TRY_CAST(year AS INT) AS year, text FROM year_texts
          WHERE year <> 'xxxx' AND TRY_CAST(year AS INT) BETWEEN 1700 AND 1911""",
    "leading_years": _with(YEAR_TEXTS)
    + " SELECT doc_id, TRY_CAST(substr(concat(year, '-01-02'), 1, 4) AS INT) AS year FROM year_texts",
    "dtm_vocabulary": _with(VOCABULARY) + " SELECT idx, token, n FROM vocab",
    "dtm_lookup": _with(VOCABULARY) + " SELECT idx, token FROM vocab",
    "dtm_sparse_docs": _with(VOCABULARY)
    + f""", term_counts AS (
            SELECT doc_id, idx, count(*) AS n FROM (SELECT doc_id, unnest({LETTER_TOKENS}) AS token FROM documents)
            JOIN vocab USING (token) GROUP BY doc_id, idx),
          packed AS (
            SELECT doc_id, count(*) AS n_terms, string_agg(concat(idx, ':', n), ' ' ORDER BY idx) AS terms
            FROM term_counts GROUP BY doc_id)
          SELECT doc_id, {YEAR} AS year, CAST(coalesce(n_terms, 0) AS INT) AS n_terms,
            concat(CAST({YEAR} AS VARCHAR), chr(9), coalesce(n_terms, 0), ' ', coalesce(terms, '')) AS value
          FROM documents LEFT JOIN packed USING (doc_id)""",
    "vocabulary_file": _with(VOCABULARY) + " SELECT idx, token FROM vocab",
    "article_file": _with(LINES, FIELDS) + " SELECT f[1] AS slug, f[2] AS title, f[3] AS text FROM fields WHERE len(f) = 3",
    "year_text_file": _with(YEAR_TEXTS)
    + f""" SELECT TRY_CAST(substr(concat(year, '-01'), 1, 4) AS INT) AS year, sha256({_flat('text')}) AS text_sha256 FROM year_texts""",
    "trainer_documents": _with(VOCABULARY)
    + f""", term_counts AS (
            SELECT doc_id, idx, count(*) AS n FROM (SELECT doc_id, unnest({LETTER_TOKENS}) AS token FROM documents)
            JOIN vocab USING (token) GROUP BY doc_id, idx),
          packed AS (
            SELECT doc_id, count(*) AS n_terms, string_agg(concat(idx, ':', n), ' ' ORDER BY idx) AS terms
            FROM term_counts GROUP BY doc_id)
          SELECT row_number() OVER (ORDER BY {YEAR}, doc_id) - 1 AS line, concat(coalesce(n_terms, 0), ' ', coalesce(terms, '')) AS value
          FROM documents LEFT JOIN packed USING (doc_id)""",
    "dtm_docs_per_year": f"SELECT {YEAR} AS year, count(*) AS n_docs FROM documents GROUP BY 1 ORDER BY 1",
    "title_overlap": _with(PAGES)
    + f""" SELECT page_id, {_slug('title')} AS slug, title, {_flat('content')} AS text FROM web
           WHERE {_slug('title')} IN (SELECT {_slug(f"concat('  ', {HEAD_LINE}, '!?')")} FROM documents)""",
    "page_articles": _with(PAGES)
    + f" SELECT page_id, concat({_slug('title')}, chr(9), title, chr(9), {_flat('content')}) AS value FROM web",
    "corpus_overlap": _with(PAGES, LINES, FIELDS)
    + f""" SELECT doc_id, value FROM fields
           WHERE f[1] IN (SELECT split_part(concat({_slug('title')}, chr(9), title), chr(9), 1) FROM web)""",
    "page_by_id": _with(PAGES) + " SELECT page_id, title, content FROM web WHERE page_id = 7",
    "page_archive": _with(PAGES) + " SELECT row_number() OVER (ORDER BY page_id) - 1 AS number, page_id, title, content FROM web",
    "page_by_number": _with(PAGES) + " SELECT page_id, title, content FROM web ORDER BY page_id LIMIT 1 OFFSET 7",
    "archived_page": _with(PAGES) + " SELECT page_id, title, content FROM web WHERE page_id = 7",
    "first_year_groups": _with(ARTICLES)
    + r""", dated AS (
            SELECT doc_id, text, list_filter(regexp_extract_all(text, '[\p{L}\p{Nd}_]+'),
              lambda r: regexp_full_match(r, '[0-9]{4}') AND TRY_CAST(r AS INT) > 500 AND TRY_CAST(r AS INT) < 2200)[1] AS year
            FROM articles),
          placed AS (
            SELECT *, coalesce(sum(length(text) + 1) OVER (
              PARTITION BY year ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM dated WHERE year IS NOT NULL)
          SELECT year, CAST(before // 8192 AS INT) AS part, count(*) AS n_docs, string_agg(text, ' ' ORDER BY doc_id) AS text
          FROM placed GROUP BY ALL""",
    "year_windows": _with(ARTICLES)
    + r""", split AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS toks FROM articles),
          hits AS (
            SELECT doc_id, toks, unnest(list_filter(range(len(toks)), lambda i: regexp_matches(toks[i + 1], '[0-9]{4}'))) AS t
            FROM split),
          runs AS (
            SELECT *, unnest(range(1, len(rs) + 1)) AS j FROM (
              SELECT doc_id, toks, t, regexp_extract_all(toks[t + 1], '[\p{L}\p{Nd}_]+') AS rs FROM hits)),
          mentions AS (
            SELECT doc_id, toks, t, j, rs[j] AS year, len(toks) AS total,
              CASE WHEN j = 1 AND starts_with(toks[t + 1], rs[1]) THEN t ELSE t + 1 END AS i
            FROM runs WHERE regexp_full_match(rs[j], '[0-9]{4}'))
          SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY t, j) - 1 AS INT) AS position, year,
            array_to_string(CASE WHEN i < total
              THEN list_concat(toks[greatest(i - 50, 0) + 1 : i], toks[i + 2 : i + 50])
              ELSE toks[greatest(total - 100, 0) + 1 : total] END, ' ') AS text
          FROM mentions""",
    "kl_pairs": _with(VECTORS)
    + f""" SELECT a.id, round({_kl('a.theta', 'b.theta')}, 6) AS kl,
             round({_kl('a.theta', 'list_transform(list_zip(a.theta, b.theta), lambda y: (y[1] + y[2]) / 2)')}, 6) AS kl_mean
           FROM thetas a JOIN thetas b ON b.id = a.id + 1""",
    "js_pairs": _with(VECTORS)
    + f" SELECT a.id, round({_js('a.theta', 'b.theta')}, 6) AS js FROM thetas a JOIN thetas b ON b.id = a.id + 1",
    "js_nearest_year": _with(
        PAGES,
        _initials("unseen", "web", "page_id", "content"),
        _initials("training", "documents", "doc_id", "text"),
    )
    + f""", scored AS (
            SELECT q.id, t.id AS train_id, t.year, {_js('q.theta', 't.theta')} AS js FROM unseen q CROSS JOIN training t)
          SELECT id, round(js, 6) AS js, train_id, year FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY js, train_id) AS place FROM scored) WHERE place = 1""",
    "js_mean_by_year_gap": _with(VECTORS)
    + f""", gaps AS (SELECT unnest({YEAR_GAPS}) AS d),
          pairs AS (
            SELECT d, a.theta AS p, b.theta AS q, row_number() OVER (PARTITION BY d ORDER BY a.id, b.id) AS place
            FROM gaps, thetas a, thetas b WHERE a.id < b.id AND abs(a.year - b.year) = d),
          kept AS (SELECT d, {_js('p', 'q')} AS js FROM pairs WHERE place <= {PAIRS_PER_GAP})
          SELECT gaps.d, count(js) AS pairs, round(avg(js), 6) AS mean_js FROM gaps LEFT JOIN kept USING (d) GROUP BY gaps.d""",
    "topic_lowest_terms": _with(CELLS, _ranked("ASC"))
    + " SELECT topic, year, place, term, round(logp, 6) AS logp FROM ranked",
    "topic_top_terms": _with(CELLS, _ranked("DESC"))
    + " SELECT topic, year, place, term, round(logp, 6) AS logp FROM ranked",
    "topic_term_lines": _with(CELLS, _ranked("ASC"))
    + """ SELECT topic, year, concat(topic, chr(9), year, chr(9), string_agg(term, ' ' ORDER BY place)) AS value
          FROM ranked GROUP BY topic, year""",
    "topic_matrix_cells": """WITH cells AS (
            SELECT label, vec_id, unnest(range(len(embedding))) AS place, unnest(embedding) AS logp FROM embeddings),
          numbered AS (
            SELECT label, logp, row_number() OVER (PARTITION BY label ORDER BY vec_id, place) - 1 AS line FROM cells)
          SELECT label AS topic, CAST(line // 100 AS INT) AS term_idx, CAST(line % 100 AS INT) AS time_idx, logp FROM numbered""",
    "topic_type_counts": _with(SOURCES, UNPACKED) + " SELECT type, topic, n FROM unpacked",
    "topic_listing": _with(SOURCES, UNPACKED)
    + """ SELECT topic, count(*) AS types, CAST(sum(n) AS BIGINT) AS total,
            left(string_agg(concat(type, ':', n), ' ' ORDER BY type), 500) AS line
          FROM unpacked GROUP BY topic""",
    "doc_topic_scores": _with(SOURCES)
    + f""", scores AS (
            SELECT doc_id, topic, CAST(sum(n) AS DOUBLE) AS score
            FROM (SELECT doc_id, unnest({LETTER_TOKENS}) AS token FROM documents) JOIN source_counts USING (token)
            GROUP BY doc_id, topic)
          SELECT doc_id, topic, score, place FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS INT) AS place FROM scores)
          WHERE place <= 5""",
    "year_pair_arcs": _with(VECTORS, PAIR_LINES)
    + r""", parsed AS (
            SELECT CAST(regexp_extract(value, '^(\d+)-(\d+),([.0-9]+)', 1) AS DOUBLE) AS year1,
                   CAST(regexp_extract(value, '^(\d+)-(\d+),([.0-9]+)', 2) AS DOUBLE) AS year2,
                   CAST(regexp_extract(value, '^(\d+)-(\d+),([.0-9]+)', 3) AS DOUBLE) AS distance
            FROM pair_lines WHERE regexp_matches(value, '^(\d+)-(\d+),([.0-9]+)')),
          logs AS (SELECT year1, year2, ln(distance) AS x FROM parsed WHERE distance > 0),
          scaled AS (
            SELECT *, (x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0) AS share FROM logs)
          SELECT year1, year2, ((year1 + year2) / 2 - 1800) * 6 AS cx, (year2 - year1) * 6 / 2 AS r,
            round(share * (0.01 - 3.0) + 3.0, 6) AS stroke_width, round(share * (0.01 - 0.5) + 0.5, 6) AS opacity
          FROM scaled""",
    "lda_topics": _with(*_topic_model("documents"))
    + f""", listed AS (
            SELECT token, k, row_number() OVER (PARTITION BY k ORDER BY round(mass, 6) DESC, token) AS place FROM mass{ROUNDS}),
          weights AS (SELECT k, alpha AS weight FROM prior{ROUNDS - 1})
          SELECT CAST(k AS INT) AS topic, round(any_value(weight), 6) AS weight, string_agg(token, ' ' ORDER BY place) AS words
          FROM listed JOIN weights USING (k) WHERE place <= 19 GROUP BY k""",
    "lda_nearest_year": _with(
        PAGES,
        f"""training AS (SELECT doc_id, {YEAR} AS year, text FROM documents WHERE {YEAR} BETWEEN 1700 AND 1911)""",
        "unseen AS (SELECT page_id AS doc_id, 1700 + page_id % 212 AS year, content AS text FROM web)",
        *_topic_model("training"),
        _topic_shares("share", f"mass{ROUNDS}"),
        *_topic_thetas("known", "training"),
        *_topic_thetas("asked", "unseen"),
    )
    + f""", scored AS (
            SELECT q.id, t.id AS train_id, t.year AS nearest_year, {_js('q.theta', 't.theta')} AS js
            FROM asked q CROSS JOIN known t),
          nearest AS (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY js, train_id) AS place FROM scored)
          SELECT doc_id, year AS actual_year, train_id, CAST(nearest_year AS INT) AS nearest_year, round(js, 6) AS js
          FROM unseen LEFT JOIN (SELECT * FROM nearest WHERE place = 1) ON doc_id = id""",
}
