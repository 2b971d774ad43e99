"""DuckDB SQL of the operators whose results SQL can express. Values are written out, not taken from the operators."""

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _escaped(c: str) -> str:
    out = rf"replace({c}, '\', '\\')"
    for s in ("<|", "|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, {_escaped('x')} AS ex, replace({_escaped('r')}, chr(10), concat('\', chr(10))) AS er FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(r, chr(10), x, chr(10)), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(er) + 1 + length(ex) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0) u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM reach r JOIN e ON r.seen = e.a)
SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.seen) AS component_id, r.node = min(r.seen) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node"""

WARC = """
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS g FROM pages),
f AS (SELECT g, min(page_id) AS original FROM d WHERE n >= 100 GROUP BY g)
SELECT page_id, n AS payload_bytes, d.g AS payload_digest, CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM d LEFT JOIN f ON d.g = f.g"""

GRID = "SELECT 'symbols' AS signal, unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]::DOUBLE[]) AS cutoff UNION ALL SELECT 'lines', unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) UNION ALL SELECT 'repeats', unnest([0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18]::DOUBLE[])"

QUALITY = rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {WORDS})) AS l FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5) u),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) c WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest(range(0, 5)) AS k) k GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    [CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END, CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END, CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END] AS v FROM c),
lab AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
one AS (
  SELECT lang, regexp_replace(lower(text), '[\x20\x09-\x0D]', '', 'g') AS body, any_value(v) AS v FROM b JOIN lab ON lab.doc_id = b.doc_id WHERE NOT base_failed
  GROUP BY 1, 2 HAVING max(quality) = 1),
g AS (SELECT signal, cutoff, CASE signal WHEN 'symbols' THEN 1 WHEN 'lines' THEN 2 ELSE 3 END AS place FROM ({GRID}) grid),
k AS (SELECT lang, signal, cutoff, count(*) AS n, count(*) FILTER (WHERE v[place] >= cutoff) AS k FROM one, g GROUP BY 1, 2, 3),
strata AS (SELECT count(DISTINCT coalesce(lang, chr(0))) AS m FROM one),
tail AS (
  SELECT lang, signal, cutoff, sum(exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - lgamma(n - i + 1) + i * ln(0.01::DOUBLE) + (n - i) * ln(0.99::DOUBLE))) AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM k WHERE k < n * 0.01) u GROUP BY 1, 2, 3),
cut AS (SELECT lang, signal, min(cutoff) AS cutoff FROM tail, strata WHERE p <= 0.05::DOUBLE / (m * 3) GROUP BY 1, 2)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (x.cutoff IS NULL OR v[1] < x.cutoff) AND (y.cutoff IS NULL OR v[2] < y.cutoff) AND (z.cutoff IS NULL OR v[3] < z.cutoff) AS kept
FROM b LEFT JOIN cut x ON x.signal = 'symbols' AND x.lang IS NOT DISTINCT FROM b.lang
LEFT JOIN cut y ON y.signal = 'lines' AND y.lang IS NOT DISTINCT FROM b.lang
LEFT JOIN cut z ON z.signal = 'repeats' AND z.lang IS NOT DISTINCT FROM b.lang"""

ORACLES = {"op3_chat_format": CHAT, "op4_minhash_near_dedup": NEAR_DUPLICATES, "op7_warc_revisits": WARC, "op8_quality_rules": QUALITY}

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
sizes AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
places AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS c FROM places GROUP BY ALL HAVING count(*) >= 100),
inner_parts AS (SELECT DISTINCT lang, c, array_to_string(string_split(phrase, ' ')[i : i + j - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS j) WHERE j < k)),
absorbed AS (SELECT lang, phrase, max(c) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN absorbed b USING (lang, phrase) WHERE f.k >= 2 AND (b.longer IS NULL OR 100 * b.longer < 100 * f.c)),
cuts AS (SELECT *, array_to_string(string_split(phrase, ' ')[1 : cut], ' ') AS x, array_to_string(string_split(phrase, ' ')[cut + 1 :], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (SELECT c.lang, c.phrase, c.cut, c.c AS a, fx.c AS l, fy.c AS r, s.n,
    (1000::HUGEINT * c.c::HUGEINT * s.n::HUGEINT // (fx.c::HUGEINT * fy.c::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN f fx ON fx.lang = c.lang AND fx.phrase = c.x JOIN f fy ON fy.lang = c.lang AND fy.phrase = c.y JOIN sizes s ON s.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest)
SELECT * FROM ranked WHERE rank <= 2000"""
ORACLES["op12_collocations"] = COLLOCATIONS
