"""DuckDB statements for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def line_dedup(docs: str, columns: str, min_docs: int = 10) -> str:
    """``columns`` of each of ``docs``, with kept (text), n_lines and n_dropped to choose from."""
    return f"""
WITH ld_docs AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
ld_lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM ld_docs),
ld_keys AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS k FROM ld_lines),
ld_common AS (SELECT k FROM ld_keys WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= {min_docs}),
ld_marked AS (SELECT doc_id, line, pos, k IN (SELECT k FROM ld_common) AS gone FROM ld_keys),
ld_done AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
    FROM ld_marked GROUP BY doc_id)
SELECT {columns} FROM ld_done JOIN ld_docs USING (doc_id)"""


#: What the formatted conversations say; their length in characters follows from the template and its escapes.
CHAT = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
        3 + sum(17 + length(role) + length(text)
            + len(regexp_extract_all(text, '[<\\[]~*(s>|/s>|INST\\]|/INST\\])'))
            + len(regexp_extract_all(role, '[<\\[]~*(s>|/s>|INST\\]|/INST\\])'))) AS formatted_chars
    FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM c"""

#: Sets of five-word shingles, links by shared shingles, and the smallest id reachable.
NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, a AS reached FROM (SELECT DISTINCT a FROM e) UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def licenses() -> str:
    """Digests of whole texts and of lines, among those of the fixed list."""
    from mnemospark.llm.licenses import COPYRIGHT_LINE, DIGESTS, KNOWN, NOT_WORD, SPELLINGS

    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def canonical(x: str) -> str:
        c = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), {quote(COPYRIGHT_LINE)}, ' ', 'g')"
        c = f"' ' || trim(regexp_replace({c}, {quote(NOT_WORD)}, ' ', 'g')) || ' '"
        for a, b in SPELLINGS:
            c = f"replace({c}, ' {a} ', ' {b} ')"
        return f"md5(trim({c}))"

    known = ", ".join(f"({quote(a)}, {quote(t)})" for a, t in KNOWN)
    digests = ", ".join(f"({quote(a)}, {quote(t)})" for a, t in DIGESTS)
    return f"""
WITH k AS (SELECT digest, min(license) AS license FROM (SELECT license, {canonical('known')} AS digest FROM (VALUES {known}) v(license, known) UNION ALL VALUES {digests}) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
h AS (SELECT doc_id, license FROM (SELECT doc_id, {canonical('line')} AS digest FROM l WHERE line <> '') JOIN k USING (digest)),
g AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n FROM h GROUP BY 1),
w AS (SELECT doc_id, {canonical('text')} AS digest FROM d)
SELECT w.doc_id, w.digest, k.license, coalesce(g.notices, '') AS notices, coalesce(g.n, 0) AS n_notices FROM w LEFT JOIN k USING (digest) LEFT JOIN g ON g.doc_id = w.doc_id"""


#: Base measures and the verdict of all rules, whose order does not matter to it.
QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
c AS (SELECT doc_id, len(w) AS n, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g')) AS bangs, length(regexp_replace(text, '[^\p{Lu}\p{Lt}]', '', 'g')) AS uppers,
    len(list_distinct(w)) AS different, len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS wordless,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g WHERE g IS NOT NULL) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM t) GROUP BY 1),
m AS (SELECT c.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup, coalesce(n_repeat, 0) AS n_repeat FROM c LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n < 50 OR 100 * n_repeat > 50 * n AS failed FROM m)
SELECT doc_id, n AS n_words, word_chars, n_symbols, n_dup AS n_dup_lines, n_repeat AS n_repeat_words, failed AS base_failed,
    NOT (failed OR n_symbols > 0.1 * n OR word_chars / n NOT BETWEEN 2.5 AND 12 OR n_dup > 0.5 * n_lines OR bangs > 0.3 * n
        OR uppers / word_chars > 0.6 OR wordless / n > 0.3 OR different / sqrt(n) < 1.5) AS kept
FROM b"""

#: Every document judged by every filter, all orders of the filters, and what each step meets.
AUDIT = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
g AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails FROM w LEFT JOIN g ON g.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT '' AS o UNION ALL SELECT o.o || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o.o, f)),
s AS (SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(o) = 5),
t AS (SELECT *, ascii(substr(filter_order, step, 1)) - 64 AS f, list_transform(range(1, step), lambda k: ascii(substr(filter_order, k, 1)) - 64) AS earlier FROM s),
x AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS bad, len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS n_fails FROM c, t),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND bad), 0) AS redundant, coalesce(sum(n) FILTER (bad AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND bad), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND bad), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round compares all parts with all entries."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT row, p, x, e, d FROM (SELECT *, row_number() OVER (PARTITION BY row, p ORDER BY d, e) AS place FROM (
    SELECT c.row, c.p, c.x, b.e, list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM c JOIN b{k} b USING (p))) WHERE place = 1)""")
        if k < rounds:
            steps.append(f"""
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT p, e, list(v ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (
        SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL) m USING (p, e))""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS row, len(x) // {parts} AS wide FROM v),
c AS MATERIALIZED (SELECT row, p, x[p * wide + 1:(p + 1) * wide] AS x FROM (SELECT *, unnest(range({parts})) AS p FROM n)),
b0 AS MATERIALIZED (SELECT p, row - 1 AS e, x FROM c WHERE row <= {entries}),
{",".join(steps)},
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(x, ',') AS t FROM b{rounds})),
r AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM n JOIN r USING (row), h"""

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup("documents", "doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256"),
    "op3_licenses": licenses(),
    "op7_near_dedup": NEAR,
    "op9_chat": CHAT,
    "op10_quality": QUALITY,
    "op11_audit": AUDIT,
    "op13_vector_codes": vector_codes(),
}
