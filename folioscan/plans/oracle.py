"""Pieces of DuckDB SQL that say what the operators do, in another engine and another regex dialect (RE2)."""

from __future__ import annotations

from folioscan.functions.text import COMMAND
from folioscan.operators.parse import CITE
from folioscan.rules import PLACEHOLDER_CAPTION, RULES
from folioscan.sources import derived as d

def duck(sql: str) -> str:
    return sql


def re2(pattern: str) -> str:
    """A Java pattern as RE2 takes it, inside a SQL text."""
    for java, other in (("(?iU)", "(?i)"), ("(?isU)", "(?is)"), ("(?sU)", "(?s)"), ("(?U)", "")):
        pattern = pattern.replace(java, other)
    return pattern.replace("'", "''")


def newlines(c: str) -> str:
    return f"(length({c}) - length(replace({c}, chr(10), '')))"


def strip(c: str) -> str:
    return f"trim({c}, ' ' || chr(10) || chr(9))"


def strip_comments(c: str) -> str:
    return rf"regexp_replace({c}, '(^|[^\\])%[^\n]*', '\1', 'g')"


def matches(source: str, column: str, pattern: str, *groups: int, keep: str = "doc_path") -> str:
    """Every match of a pattern: the kept columns, idx, line, text, tail and g1, g2, ..."""
    taken = ", ".join(f"regexp_extract_all({column}, '{pattern}', {g}) AS all{g}" for g in (0, *groups))
    shown = "".join(f", all{g}[i] AS g{g}" for g in groups)
    before = "(array_to_string(gaps[1:i], '') || array_to_string(all0[1:i-1], ''))"
    return f"""SELECT {keep}, i - 1 AS idx, 1 + {newlines(before)} AS line, all0[i] AS text, gaps[i+1] AS tail{shown}
  FROM (SELECT *, unnest(range(1, len(all0) + 1)) AS i FROM (SELECT {keep}, {taken}, string_split_regex({column}, '{pattern}') AS gaps FROM {source}) x) y"""


TEX = f"tex AS ({d.TEX_DOCS})"
LINES = "lines AS (SELECT doc_path, i AS combined_line, parts[i] AS text FROM (SELECT doc_path, parts, unnest(range(1, len(parts))) AS i FROM (SELECT doc_path, string_split(source, chr(10)) AS parts FROM tex) x) y)"
CITES = f"""cites AS (SELECT doc_path, row_number() OVER (PARTITION BY doc_path ORDER BY idx, k) - 1 AS cite_idx, key, line FROM (
  SELECT doc_path, idx, line, k, trim(keys[k]) AS key FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS k FROM (SELECT *, string_split(g1, ',') AS keys FROM ({matches('(SELECT doc_path, ' + strip_comments('source') + ' AS s FROM tex)', 's', CITE, 1)}) m) n) o) q WHERE key <> '')"""
RESOURCES = r"""resources AS (SELECT doc_path, i - 1 AS res_idx, names[i] AS name FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM (
  SELECT doc_path, list_concat(flatten([[trim(n) for n in string_split(x, ',')] for x in regexp_extract_all(source, '\\bibliography\{([^}]+)\}', 1)]), regexp_extract_all(source, '\\addbibresource\{([^}]+)\}', 1)) AS names FROM tex) a) b)"""
GRAPHICS = "graphics AS (SELECT doc_path, idx AS img_idx, trim(g1) AS raw_path, line FROM (" + matches("tex", "source", r"\\includegraphics(?:\s*\[[^\]]*\])?\s*\{([^}]+)\}", 1) + ") m WHERE NOT regexp_matches(lower(trim(g1)), '[.](tex|cls|sty|bib|bst)$'))"
REFS = r"refs AS (SELECT DISTINCT doc_path, trim(unnest(regexp_extract_all(source, '\\ref\s*\{([^}]*)\}', 1))) AS label FROM tex)"
_FLOAT = r"(?s)\\begin\{figure\*?\}\s+(.*?)\s+\\end\{figure\*?\}|\\begin\{table\*?\}\s+(.*?)\s+\\end\{table\*?\}"
_CAPTION = r"\\caption\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}"
FLOATS = f"""floats AS (SELECT *, CASE WHEN regexp_matches(content, '{_CAPTION}') THEN trim(regexp_extract(content, '{_CAPTION}', 1)) END AS caption, regexp_extract_all(content, '\\\\label\\s*\\{{([^}}]*)\\}}', 1) AS labels FROM (
  SELECT doc_path, idx AS float_idx, CASE WHEN text LIKE '_begin{{fig%' THEN 'figure' ELSE 'table' END AS env_type, CASE WHEN text LIKE '_begin{{fig%' THEN g1 ELSE g2 END AS content, line AS start_line, line + {newlines('text')} AS end_line FROM ({matches('tex', 'source', _FLOAT, 1, 2)}) m) n)"""
LABELS = "labels AS (SELECT doc_path, float_idx, k - 1 AS label_idx, env_type, labels[k] AS label, start_line AS line FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS k FROM floats) x)"
CAPTIONS = re2(PLACEHOLDER_CAPTION)
NEAR_EMPTY = rf"NOT regexp_matches(content, '\\includegraphics|\\begin\{{(?:tabular|tabularx|tabulary|longtable|array|tikzpicture|pgfpicture|asy|pspicture)\}}|(?:\\lstinputlisting|\\input|\\import)\s*\{{') AND len([w for w in string_split_regex(regexp_replace(content, '{COMMAND}', '', 'g'), '\s+') if w <> '']) < 2"
BIB_HEADERS = "headers AS (SELECT path AS file, idx AS bib_idx, g2 AS key, lower(g1) AS entry_type, line, tail AS block FROM (" + matches(f"(SELECT path, {strip_comments('source')} AS s FROM ({d.BIB_FILES}) b)", "s", r"(?m)^[ \t]*@(\w+)\s*\{\s*([^,\s}]+)\s*,", 1, 2, keep="path") + ") m)"

_BEGIN = "'" + chr(92) + "begin{document}'"
_REST = f"substr(source, instr(source, {_BEGIN}) + 17)"
_CUT = "CASE WHEN instr(rest, '" + chr(92) + "begin{thebibliography}') > 0 THEN least(instr(rest, '" + chr(92) + "begin{thebibliography}'), instr(rest, '" + chr(92) + "end{document}')) ELSE instr(rest, '" + chr(92) + "end{document}') END"
BODY = f"{TEX}, body AS (SELECT doc_path, substr(rest, 1, {_CUT} - 1) AS body, 1 + {newlines('substr(source, 1, length(source) - length(rest))')} AS start_line FROM (SELECT doc_path, source, {_REST} AS rest FROM tex) x)"
_PREAMBLE = f"preamble AS (SELECT doc_path, split_part(source, {_BEGIN}, 1) AS preamble, 1 AS start_line FROM tex)"
PREAMBLE = f"{TEX}, {_PREAMBLE}"


def artifacts(column: str, severity: str) -> str:
    parts = [
        f"SELECT doc_path, {k} AS rule_idx, idx AS match_idx, '{r.category}' AS category, '{re2(r.message)}' AS message, line + start_line - 1 AS line, {strip('substr(text, 1, 80)')} AS excerpt FROM ({matches(column, column, re2(r.pattern), keep='doc_path, start_line')}) m"
        for k, r in enumerate(RULES)
        if r.severity == severity and r.number != "R20"
    ]
    return f"found AS ({' UNION ALL '.join(parts)})"


PARAGRAPHS = f"""plines AS (SELECT doc_path, i, parts[i] AS line, start_line FROM (SELECT doc_path, start_line, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_path, start_line, string_split({strip_comments('body')}, chr(10)) AS parts FROM body) x) y),
paragraphs AS (SELECT doc_path, row_number() OVER (PARTITION BY doc_path ORDER BY min(i)) - 1 AS para_idx, {strip("string_agg(line, chr(10) ORDER BY i)")} AS text, any_value(start_line) + min(i) - 1 AS start_line, any_value(start_line) + max(i) - 1 AS end_line
  FROM (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_path ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM plines) g WHERE trim(line) <> '' GROUP BY doc_path, grp)"""
PROSE = f"len(regexp_extract_all(regexp_replace(text, '{COMMAND}', ' ', 'g'), '[A-Za-z]{{3,}}')) >= 3"
SECTIONS = f"""sections AS (SELECT doc_path, idx AS sec_idx, trim(g1) AS title, {strip('text || tail')} AS text, start_line + line - 1 AS start_line, start_line + line - 1 + {newlines('(text || tail)')} AS end_line
  FROM ({matches('(SELECT doc_path, start_line, ' + strip_comments('body') + ' AS s FROM body)', 's', chr(92) * 2 + 'section' + chr(92) + '*?' + chr(92) + 's*' + chr(92) + '{([^}]*)' + chr(92) + '}', 1, keep='doc_path, start_line')}) m)"""
_ITEM = r"\\bibitem\s*(?:\[[^\]]*\])?\s*\{([^}]+)\}"
_BLOCK = r"(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}"
INLINE = f"""blocks AS (SELECT doc_path, idx AS block, line AS base, text AS inner_text FROM ({matches('tex', 'source', _BLOCK)}) m),
inline_items AS (SELECT doc_path, block * 1000000000000 + idx AS bib_idx, trim(g1) AS key, base + line - 1 AS line, trim(coalesce(nullif(regexp_extract(tail, '``([^'']+?)''''', 1), ''), regexp_extract(tail, '\\\\(?:textit|emph|textbf)\\s*\\{{([^}}]+)\\}}', 1))) AS title FROM ({matches('blocks', 'inner_text', _ITEM, 1, keep='doc_path, block, base')}) n)"""
BIB = f"bib AS (SELECT bib_key AS key, entry_type, file, line, title, eprint, doi FROM ({d.BIB_ROWS}) b), ranked AS (SELECT *, row_number() OVER w AS n, first_value(line) OVER w AS first_line, row_number() OVER (PARTITION BY key ORDER BY line DESC) AS n_last FROM bib WINDOW w AS (PARTITION BY key ORDER BY line))"


def includes(sources: str) -> str:
    """Every file of (path, source) as a root, with its includes in place."""
    return rf"""files AS ({sources}),
flines AS (SELECT path, i AS line, parts[i] AS text FROM (SELECT path, parts, unnest(range(1, len(parts))) AS i FROM (SELECT path, string_split(source, chr(10)) AS parts FROM files) x) y),
named AS (SELECT path AS parent, line, regexp_extract(text, '\{{([^}}]+)\}}', 1) AS name FROM flines WHERE regexp_matches(text, '^\\(input|include)\{{')),
edges AS (SELECT parent, line, CASE WHEN name || '.tex' IN (SELECT path FROM files) THEN name || '.tex' ELSE name END AS child FROM named),
tree AS (SELECT path AS doc_path, path, [path] AS stack, []::BIGINT[] AS ord FROM files
  UNION ALL SELECT t.doc_path, e.child, list_append(t.stack, e.child), list_append(t.ord, e.line) FROM tree t JOIN edges e ON t.path = e.parent WHERE NOT list_contains(t.stack, e.child)),
placed AS (SELECT t.doc_path, list_append(t.ord, f.line) AS ord, f.text, f.path AS origin_file, f.line AS origin_line FROM tree t JOIN flines f USING (path) WHERE NOT regexp_matches(f.text, '^\\(input|include)\{{')
  UNION ALL SELECT doc_path, ord, '% folioscan: could not read ' || path, path, 1 FROM tree WHERE path NOT IN (SELECT path FROM files)
  UNION ALL SELECT t.doc_path, list_append(t.ord, e.line), '% folioscan: cycle, not expanded: ' || e.child, e.child, 1 FROM tree t JOIN edges e ON t.path = e.parent WHERE list_contains(t.stack, e.child)),
expanded AS (SELECT doc_path, row_number() OVER (PARTITION BY doc_path ORDER BY ord) AS combined_line, text, origin_file, origin_line FROM placed)"""


INCLUDES, TREE_INCLUDES = includes(d.INCLUDE_FILES), includes(d.TREE_FILES)
#: Paragraphs of the expanded sources: runs of lines that are not blank without their comments, at the places that their first and last lines came from.
ORIGINS = f"""{TREE_INCLUDES}, elines AS (SELECT doc_path, combined_line, origin_file, origin_line, {strip_comments('text')} AS text FROM expanded),
runs AS (SELECT *, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_path ORDER BY combined_line ROWS UNBOUNDED PRECEDING) AS run FROM elines)
SELECT doc_path, row_number() OVER (PARTITION BY doc_path ORDER BY min(combined_line)) - 1 AS para_idx, arg_min(origin_file, combined_line) AS file, arg_min(origin_line, combined_line) AS start_line, arg_max(origin_line, combined_line) AS end_line
FROM runs WHERE trim(text) <> '' GROUP BY doc_path, run"""
SOURCES = f"{TREE_INCLUDES} SELECT doc_path, string_agg(text || chr(10), '' ORDER BY combined_line) AS source FROM expanded GROUP BY doc_path"
PAPERS = f"""hits AS ({d.PAPER_HITS}), papers AS (SELECT query, {strip('title')} AS title, CAST(year AS BIGINT) AS year, {strip('abstract')} AS abstract, coalesce(nullif(url, ''), arxiv) AS url FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY (lower({strip('title')}) = lower({strip('query')})) DESC, hit_rank) AS n FROM hits) x WHERE n = 1 AND title <> '')"""
_NONE = "CAST(NULL AS VARCHAR)"
GRAMMAR = rf"""WITH docs AS (SELECT doc_id, text, 'd' || CAST(doc_id AS VARCHAR) AS doc_path FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) t WHERE {PROSE})
SELECT doc_path, 'grammar' AS checker, severity, CAST(5 AS BIGINT) AS line, message, excerpt, {_NONE} AS file FROM (
  SELECT doc_path, 'info' AS severity, 'm' AS message, nullif({strip("substr(replace(split_part(text, chr(10), 1), chr(34), ''), 1, 8)")}, '') AS excerpt FROM docs WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_path, 'warning', 'vague', {_NONE} FROM docs WHERE doc_id % 4 = 2 UNION ALL SELECT doc_path, 'warning', 'second', {_NONE} FROM docs WHERE doc_id % 4 = 2
  UNION ALL SELECT doc_path, 'warning', 'm', chr(92) || 'cite{{x}}' FROM docs WHERE doc_id % 4 = 3) r"""
CLAIMS = rf"""WITH {BODY}, {PARAGRAPHS}, {BIB}, {PAPERS},
c AS (SELECT doc_path, para_idx, start_line, trim(string_split(regexp_extract(text, '{CITE}', 1), ',')[1]) AS key FROM paragraphs WHERE regexp_matches(text, '{CITE}')),
j AS (SELECT c.*, r.title, CASE WHEN r.key IS NULL THEN 'unknown' WHEN r.title = '' THEN 'untitled' WHEN p.query IS NULL THEN 'unfound' WHEN p.abstract = '' THEN 'empty' ELSE 'ready' END AS state
  FROM c LEFT JOIN (SELECT * FROM ranked WHERE n_last = 1) r USING (key) LEFT JOIN papers p ON p.query = r.title)
SELECT doc_path, 'claims' AS checker, CASE WHEN state <> 'ready' THEN 'info' WHEN para_idx % 3 = 1 THEN 'error' ELSE 'warning' END AS severity, start_line AS line,
  CASE state WHEN 'unknown' THEN 'Unknown cite key ''' || key || ''' in claim: it holds' WHEN 'untitled' THEN 'No title in bib for ''' || key || ''', so the claim cannot be checked: it holds'
    WHEN 'unfound' THEN 'Could not retrieve abstract for ''' || key || ''' (''' || replace(title, chr(10), '\n') || '''); claim not checked.' WHEN 'empty' THEN 'The record found for ''' || key || ''' has no abstract; claim not checked.'
    ELSE CASE WHEN para_idx % 3 = 1 THEN '[contradicts] claim ''it holds'' vs ' || key || ': r' ELSE '[unclear] claim ''it holds'' vs ' || key || ': ' END END AS message, {_NONE} AS excerpt, doc_path AS file
FROM j WHERE state <> 'ready' OR para_idx % 3 <> 0"""
_ORDERED = f"""{FLOATS}, {LABELS}, {REFS}, {GRAPHICS}, listing AS ({d.IMAGE_FILES}), ordered AS (
  SELECT doc_path, 'figures' AS checker, 'error' AS severity, start_line AS line, [0, float_idx, 0, 0] AS ord, env_type || ' is missing a ' || chr(92) || 'caption{{}}' AS message, {_NONE} AS excerpt, 'Give this float a caption that says what it shows.' AS suggestion FROM floats WHERE caption IS NULL
  UNION ALL SELECT doc_path, 'figures', 'error', start_line, [0, float_idx, 1, 0], env_type || ' has a placeholder caption: ' || substr(caption, 1, 60), substr(caption, 1, 80), 'Put a real caption here.' FROM floats WHERE regexp_matches(caption, '{CAPTIONS}')
  UNION ALL SELECT doc_path, 'figures', 'warning', line, [0, float_idx, 2, label_idx], env_type || ' label ''' || label || ''' is not referenced by any ' || chr(92) || 'ref{{}}', {_NONE}, 'Refer to it with ' || chr(92) || 'ref{{' || label || '}}, or drop the label.' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_path = l.doc_path AND r.label = l.label)
  UNION ALL SELECT doc_path, 'figures', 'warning', start_line, [0, float_idx, 3, 0], 'Near-empty ' || env_type || ' at line ' || CAST(start_line AS VARCHAR) || ': nothing of substance inside', {_NONE}, 'Add an image, a table or a diagram.' FROM floats WHERE {NEAR_EMPTY}
  UNION ALL SELECT doc_path, 'images', 'error', line, [1, img_idx, 0, 0], 'Image file not found: ''' || raw_path || '''', substr(raw_path, 1, 80), 'Add the file for ' || chr(92) || 'includegraphics{{' || raw_path || '}}, or drop the command.' FROM graphics WHERE raw_path NOT IN (SELECT path FROM listing))"""
FINDINGS = f"""{TEX}, {_ORDERED},
findings AS (SELECT doc_path, row_number() OVER (PARTITION BY doc_path ORDER BY ord) AS seq, checker, severity, line, message, excerpt, suggestion FROM ordered)"""
REPORT_TEXT = f"""WITH {FINDINGS}, shown AS (SELECT doc_path, line, checker, seq, unnest([0, 1, 2]) AS part, unnest([
    severity || ' ' || doc_path || ':' || CAST(line AS VARCHAR) || ' ' || checker || ' ' || message, '    > ' || excerpt, '    suggest: ' || suggestion]) AS text FROM findings),
n AS (SELECT tex.doc_path, count(f.seq) AS n FROM tex LEFT JOIN findings f USING (doc_path) GROUP BY ALL),
placed AS (SELECT doc_path, [0, line] AS a, checker AS b, [seq, part] AS c, text FROM shown WHERE text IS NOT NULL
  UNION ALL SELECT doc_path, [1, 0], '', [0, 0], '' FROM n WHERE n > 0 UNION ALL SELECT doc_path, [1, 1], '', [0, 0], CAST(n AS VARCHAR) || ' issue(s)' FROM n WHERE n > 0
  UNION ALL SELECT doc_path, [1, 2], '', [0, 0], doc_path || ': no issues found' FROM n WHERE n = 0)
SELECT doc_path, row_number() OVER (PARTITION BY doc_path ORDER BY a, b, c) - 1 AS line_no, text FROM placed"""
#: What the rules must find in the planted texts, said by the texts and not by the patterns.
RULE_FINDINGS = f"""SELECT concat('d', CAST(doc_id AS STRING), '.tex') AS doc_path, doc_id % 20 + 1 AS rule, doc_id % 40 >= 20 AS in_preamble,
  CASE WHEN doc_id % 20 < 15 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN doc_id % 40 >= 20 THEN 2 ELSE 4 END + doc_id % 3 AS line, {d.rule_case(1)} AS excerpt FROM documents"""


def _artifact_part(part: int, level: int, column: str, severity: str) -> str:
    return f"SELECT doc_path, 1 AS place, [{part}, {level}, rule_idx, match_idx] AS ord, 'artifacts' AS checker, '{severity}' AS severity, line, message, excerpt, {_NONE} AS file FROM (WITH {artifacts(column, severity)} SELECT * FROM found) f{part}{level}"


#: All eight checks; each document has the bibliography that it names, else the one inside it.
WHOLE = rf"""WITH {BODY}, {_PREAMBLE}, {CITES}, {RESOURCES}, {INLINE}, {BIB}, {PARAGRAPHS}, {SECTIONS}, {PAPERS}, {_ORDERED}, v AS ({d.VERIFICATION_ROWS}),
own AS (SELECT doc_path, line AS bib_idx, key, 'refs.bib' AS file, line, title, eprint, doi FROM (SELECT doc_path FROM resources WHERE name = 'refs') r, bib),
entries AS (SELECT * FROM own UNION ALL SELECT doc_path, bib_idx, key, doc_path, line, title, '', '' FROM inline_items WHERE doc_path NOT IN (SELECT doc_path FROM own)),
defined AS (SELECT *, row_number() OVER w AS n, first_value(line) OVER w AS first_line, first_value(bib_idx) OVER w AS first_idx, first_value(CASE WHEN eprint <> '' THEN eprint ELSE doi END) OVER w AS target,
  row_number() OVER (PARTITION BY doc_path, key ORDER BY bib_idx DESC) AS n_last FROM entries WINDOW w AS (PARTITION BY doc_path, key ORDER BY bib_idx)),
prose AS (SELECT *, instr(text, 'See') AS pos FROM paragraphs WHERE {PROSE}),
cited AS (SELECT doc_path, para_idx, start_line, list_sort([trim(k) for k in string_split(regexp_extract(text, '{CITE}', 1), ',')])[1] AS key FROM paragraphs WHERE regexp_matches(text, '{CITE}')),
judged AS (SELECT c.*, e.title, CASE WHEN e.key IS NULL THEN 'unknown' WHEN e.title = '' THEN 'untitled' WHEN p.query IS NULL THEN 'unfound' WHEN p.abstract = '' THEN 'empty' ELSE 'ready' END AS state
  FROM cited c LEFT JOIN (SELECT * FROM defined WHERE n_last = 1) e USING (doc_path, key) LEFT JOIN papers p ON p.query = e.title),
everything AS ({_artifact_part(0, 0, "body", "error")} UNION ALL {_artifact_part(0, 1, "body", "warning")} UNION ALL {_artifact_part(1, 0, "preamble", "error")} UNION ALL {_artifact_part(1, 1, "preamble", "warning")}
  UNION ALL SELECT doc_path, CASE checker WHEN 'figures' THEN 2 ELSE 3 END, ord, checker, severity, line, message, excerpt, {_NONE} FROM ordered
  UNION ALL SELECT doc_path, 4, [0, cite_idx, 0], 'citations', 'error', line, 'Cited key ''' || key || ''' not found in the bibliography.', chr(92) || 'cite{{' || key || '}}', {_NONE} FROM cites c WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.doc_path = c.doc_path AND e.key = c.key)
  UNION ALL SELECT doc_path, 4, [1, bib_idx, 0], 'citations', 'info', line, 'Unused bibliography entry ''' || key || '''.', {_NONE}, file FROM defined x WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM cites c WHERE c.doc_path = x.doc_path AND c.key = x.key)
  UNION ALL SELECT doc_path, 4, [1, first_idx, n], 'citations', 'warning', line, 'Duplicate bibliography key ''' || key || ''' (first defined at ' || file || ':' || CAST(first_line AS VARCHAR) || ').', {_NONE}, file FROM defined WHERE n > 1
  UNION ALL SELECT doc_path, 5, [bib_idx], 'references', 'error', line, 'Reference ''' || key || '''' || CASE WHEN eprint <> '' THEN ' has arXiv ID ''' || eprint || ''' but arXiv knows nothing of it: ' ELSE ' has DOI ''' || doi || ''' but doi.org knows nothing of it: ' END || v.detail, {_NONE}, file
    FROM defined x JOIN v ON v.target_id = x.target WHERE NOT v.found
  UNION ALL SELECT doc_path, 6, [para_idx, 0], 'grammar', 'info', start_line + CASE WHEN pos > 0 THEN {newlines("substr(text, 1, pos - 1)")} ELSE 0 END, 'm', 'See', doc_path FROM prose WHERE para_idx % 3 = 1
  UNION ALL SELECT doc_path, 6, [para_idx, k], 'grammar', 'warning', start_line, CASE k WHEN 0 THEN 'vague' ELSE 'second' END, {_NONE}, doc_path FROM prose, (SELECT unnest([0, 1]) AS k) t WHERE para_idx % 3 = 2
  UNION ALL SELECT doc_path, 7, [sec_idx, 0], 'reviewer', CASE sec_idx % 3 WHEN 1 THEN 'error' ELSE 'info' END, start_line, CASE sec_idx % 3 WHEN 0 THEN '[clarity] c' WHEN 1 THEN 'no category' ELSE '[scope] s' END, {_NONE}, doc_path FROM sections WHERE text <> ''
  UNION ALL SELECT doc_path, 8, [para_idx, 0, 0], 'claims', CASE WHEN state <> 'ready' THEN 'info' WHEN para_idx % 3 = 1 THEN 'error' ELSE 'warning' END, start_line,
    CASE state WHEN 'unknown' THEN 'Unknown cite key ''' || key || ''' in claim: it holds' WHEN 'untitled' THEN 'No title in bib for ''' || key || ''', so the claim cannot be checked: it holds'
      WHEN 'unfound' THEN 'Could not retrieve abstract for ''' || key || ''' (''' || replace(title, chr(10), '\n') || '''); claim not checked.' WHEN 'empty' THEN 'The record found for ''' || key || ''' has no abstract; claim not checked.'
      ELSE CASE WHEN para_idx % 3 = 1 THEN '[contradicts] claim ''it holds'' vs ' || key || ': r' ELSE '[unclear] claim ''it holds'' vs ' || key || ': ' END END, {_NONE}, doc_path FROM judged WHERE state <> 'ready' OR para_idx % 3 <> 0)
SELECT doc_path, row_number() OVER (PARTITION BY doc_path ORDER BY place, ord) AS seq, checker, severity, CAST(line AS BIGINT) AS line, message, excerpt, file FROM everything"""
