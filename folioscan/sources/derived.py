"""LaTeX-shaped relations derived from plain tables, in SQL that Spark and DuckDB read alike.

chr(92) is the backslash and chr(10) the line end, so no text needs escaping. All arithmetic is on integer ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "benchmark", "part", "pages")

TEX_DOCS = """SELECT doc_id, concat('d', CAST(doc_id AS STRING), '.tex') AS doc_path,
  concat(chr(92), 'documentclass{article}', chr(10),
    CASE WHEN doc_id % 17 = 0 THEN concat(chr(92), 'label{sec:placeholder}', chr(10)) ELSE '' END,
    chr(92), 'begin{document}', chr(10),
    CASE WHEN doc_id % 8 <> 3 THEN concat(chr(92), 'section{Part ', CAST(doc_id % 5 AS STRING), '}', chr(10)) ELSE '' END,
    replace(coalesce(text, ''), chr(10), concat(chr(10), chr(10))), chr(10),
    'See ', chr(92), 'cite{item', CAST(doc_id % 53 AS STRING), ', item', CAST((doc_id * 7) % 61 AS STRING), '}.', chr(10),
    CASE doc_id % 7 WHEN 0 THEN 'As an AI language model, this stops.'
      WHEN 1 THEN concat(chr(92), 'lipsum[1-2]')
      WHEN 2 THEN 'TODO: add the missing numbers.'
      WHEN 3 THEN concat('% ', chr(92), 'cite{hidden', CAST(doc_id AS STRING), '}')
      WHEN 4 THEN concat('Would you like me to expand on this? ', chr(92), 'includegraphics{extra.TEX}')
      ELSE 'A plain closing sentence.' END, chr(10), chr(10),
    chr(92), 'section*{Closing}', chr(10),
    CASE doc_id % 5
      WHEN 0 THEN concat(chr(92), 'begin{figure}', chr(10), chr(92), 'includegraphics{img', CAST(doc_id % 40 AS STRING), '.png}', chr(10),
        chr(92), 'caption{Shape of the curve.}', chr(10), chr(92), 'label{fig:', CAST(doc_id AS STRING), '}', chr(10), chr(92), 'end{figure}', chr(10))
      WHEN 1 THEN concat(chr(92), 'begin{table}', chr(10), chr(92), 'label{tab:', CAST(doc_id AS STRING), '}', chr(10), chr(92), 'end{table}', chr(10))
      WHEN 2 THEN concat(chr(92), 'begin{figure}[t]', chr(10), 'unseen', chr(10), chr(92), 'end{figure}', chr(10))
      WHEN 3 THEN concat(chr(92), 'begin{figure*}', chr(10), chr(92), 'caption{Insert caption here}', chr(10), 'two words', chr(10), chr(92), 'end{figure*}', chr(10))
      ELSE '' END,
    CASE WHEN doc_id % 2 = 0 THEN concat('As in ', chr(92), 'ref{fig:', CAST(doc_id AS STRING), '}.', chr(10)) ELSE '' END,
    CASE WHEN doc_id % 6 = 1 THEN concat(chr(92), 'bibliography{refs, more', CAST(doc_id % 3 AS STRING), '}', chr(10), chr(92), 'addbibresource{extra.bib}', chr(10)) ELSE '' END,
    CASE WHEN doc_id % 9 = 4 THEN concat(chr(92), 'begin{thebibliography}{9}', chr(10), chr(92), 'bibitem{item', CAST(doc_id % 53 AS STRING), '} A. Author. ', chr(92), 'emph{A title}. 2001.', chr(10),
      chr(92), 'bibitem[B]{own', CAST(doc_id AS STRING), '} B. Author. ', chr(96), chr(96), 'Quoted ', CAST(doc_id AS STRING), chr(39), chr(39), '. 2002.', chr(10), chr(92), 'end{thebibliography}', chr(10)) ELSE '' END,
    chr(92), 'end{document}', chr(10)) AS source
FROM documents"""

BIB_ROWS = """SELECT concat(CASE WHEN rep = 2 THEN 'spare' ELSE 'item' END, CAST(item_id AS STRING)) AS bib_key, 'article' AS entry_type, 'refs.bib' AS file,
  CAST(item_id * 6 + rep * 2 + 1 AS INT) AS line,
  CASE WHEN item_id % 11 = 0 THEN '' ELSE substring(text, 1, 40) END AS title,
  CASE WHEN item_id % 3 = 0 THEN concat('2401.', CAST(10000 + item_id AS STRING)) ELSE '' END AS eprint,
  CASE WHEN item_id % 3 = 1 THEN concat('10.1000/', CAST(item_id AS STRING)) ELSE '' END AS doi
FROM benchmark CROSS JOIN (SELECT 0 AS rep UNION ALL SELECT 1 AS rep UNION ALL SELECT 2 AS rep) r
WHERE rep = 0 OR (rep = 1 AND item_id % 9 = 0) OR (rep = 2 AND item_id % 10 = 5)"""

#: One text for each artifact rule in turn, and what the rule must show of it.
RULE_TEXTS = (
    ("'Here is a 200-word summary of it.'", "'Here is a 200-word summary'"),
    ("'Would you like me to make changes now?'", "'Would you like me to make changes'"),
    ("concat('I', chr(39), 'd be happy to help.')", "concat('I', chr(39), 'd be happy to')"),
    ("'So Id be glad to go on.'", "'Id be glad to'"),
    ("'Fill in the actual values later.'", "'Fill in the actual values'"),
    ("'These results are illustrative only.'", "'These results are illustrative'"),
    ("'This is a draft section.'", "'This is a draft section'"),
    ("'Please insert your text here.'", "'insert your text here'"),
    ("'See [insert figure below].'", "'[insert figure below]'"),
    ("'As an AI assistant it ends.'", "'As an AI assistant'"),
    ("'I do not have access to the internet.'", "'I do not have access to the internet'"),
    ("concat('I can', chr(39), 't provide it.')", "concat('I can', chr(39), 't provide')"),
    ("concat('I', chr(39), 'm sorry, but I stop.')", "concat('I', chr(39), 'm sorry, but I')"),
    ("concat(chr(92), 'caption{Your caption here}')", "concat(chr(92), 'caption{Your caption here}')"),
    ("concat(chr(92), 'label{fig:xxx}')", "concat(chr(92), 'label{fig:xxx}')"),
    ("concat(chr(92), 'lipsum[1-2] and more')", "concat(chr(92), 'lipsum[1-2]')"),
    ("concat(chr(92), 'blindtext[2]')", "concat(chr(92), 'blindtext[2]')"),
    ("'TODO: write the end.'", "'TODO: write'"),
    ("'A FIXME is left.'", "'FIXME'"),
    (
        "concat(chr(92), 'begin{tabular}{ll}', chr(10), 'One & 1', chr(92), chr(92), chr(10), 'Two & 2', chr(92), chr(92), chr(10), 'Six & 6', chr(92), chr(92), chr(10), chr(92), 'end{tabular}')",
        "concat(chr(92), 'begin{tabular}{ll}', chr(10), 'One & 1', chr(92), chr(92), chr(10), 'Two & 2', chr(92), chr(92), chr(10), 'Six & 6')",
    ),
)


def rule_case(place: int) -> str:
    """The text (0) or what is to be shown of it (1), by the document's number."""
    return "CASE doc_id % 20 " + " ".join(f"WHEN {k} THEN {texts[place]}" for k, texts in enumerate(RULE_TEXTS)) + " END"


#: The texts stand in the body of half of the documents and in the preamble of the others, on different lines.
RULE_DOCS = f"""SELECT doc_id, concat('d', CAST(doc_id AS STRING), '.tex') AS doc_path, concat(chr(92), 'documentclass{{article}}', chr(10),
    CASE WHEN doc_id % 40 >= 20 THEN concat(repeat(chr(10), CAST(doc_id % 3 AS INT)), {rule_case(0)}, chr(10)) ELSE '' END,
    chr(92), 'begin{{document}}', chr(10), 'Plain words.', chr(10),
    CASE WHEN doc_id % 40 < 20 THEN concat(repeat(chr(10), CAST(doc_id % 3 AS INT)), {rule_case(0)}, chr(10)) ELSE '' END,
    chr(92), 'end{{document}}', chr(10)) AS source
FROM documents"""

BIB_FILES = """SELECT concat('b', CAST(item_id AS STRING), '.bib') AS path,
  concat('@string{who = "Some Body"}', chr(10), '% @book{hidden,', chr(10), '@Article{item', CAST(item_id AS STRING), ',', chr(10),
    '  title = {The {Part} ', CAST(item_id AS STRING), '},', chr(10), '  author = who # " and Others",', chr(10),
    CASE WHEN item_id % 3 = 0 THEN concat('  eprint = {2401.', CAST(10000 + item_id AS STRING), '},', chr(10)) ELSE '' END,
    CASE WHEN item_id % 3 = 1 THEN concat('  doi = "10.1000/', CAST(item_id AS STRING), '",', chr(10)) ELSE '' END,
    '  year = 2001', chr(10), '}', chr(10), '@book{next', CAST(item_id % 7 AS STRING), ', title = "Next"}', chr(10)) AS source
FROM benchmark"""

_NUMBER = "CAST(regexp_extract(doc_path, '[0-9]+', 0) AS BIGINT)"
#: The documents, each of which names two of these files at its end.
NAMING_DOCS = f"""SELECT doc_path, concat(source, chr(92), 'bibliography{{b', CAST({_NUMBER} % 43 AS STRING), ', b', CAST(({_NUMBER} * 3) % 41 AS STRING), '}}', chr(10)) AS source
FROM ({TEX_DOCS}) t"""

VERIFICATION_ROWS = """SELECT CASE WHEN item_id % 3 = 0 THEN 'arxiv' ELSE 'doi' END AS target_kind,
  CASE WHEN item_id % 3 = 0 THEN concat('2401.', CAST(10000 + item_id AS STRING)) ELSE concat('10.1000/', CAST(item_id AS STRING)) END AS target_id,
  item_id % 5 <> 0 AS found, concat('detail ', CAST(item_id AS STRING)) AS detail
FROM benchmark WHERE item_id % 3 <> 2"""

PAPER_HITS = """SELECT substring(b.text, 1, 40) AS query, k AS hit_rank,
  CASE WHEN k = item_id % 4 THEN substring(b.text, 1, 40) WHEN k = 0 AND item_id % 10 = 3 THEN '' ELSE concat('Other ', CAST(item_id + k AS STRING)) END AS title,
  CAST(2000 + item_id % 25 AS STRING) AS year, CASE WHEN item_id % 4 = 0 THEN '' ELSE b.text END AS abstract,
  CASE WHEN item_id % 2 = 0 THEN concat('https://p/', CAST(item_id AS STRING)) ELSE '' END AS url, concat('a', CAST(item_id AS STRING)) AS arxiv
FROM benchmark b CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) r WHERE item_id % 7 <> 6"""

IMAGE_FILES = "SELECT concat('img', CAST(p_partkey AS STRING), '.png') AS path FROM part WHERE p_partkey % 3 <> 0 AND p_partkey < 100"

#: The files that documents may name as bibliographies.
BIB_LISTING = "SELECT 'refs.bib' AS path UNION ALL SELECT 'more1.bib' AS path"

_PAGE_FILES = """SELECT concat('p', CAST(page_id AS STRING), '.tex') AS path,
  concat('head ', CAST(page_id AS STRING), chr(10),
    chr(92), 'input{{p', CAST(CASE WHEN page_id % 13 = 12 THEN CAST({back} AS BIGINT) ELSE page_id * 2 + 1 END AS STRING), '}}', chr(10),
    '% ', chr(92), 'input{{p0}}', chr(10), 'middle', chr(10),
    chr(92), 'include{{p', CAST(page_id * 2 + 2 AS STRING), '.tex}}', chr(10), 'tail', chr(10)) AS source
FROM pages"""

#: Pages that include each other; every 13th includes the first page, so below most roots nearly all pages are expanded once more and the result grows with the square of the pages.
INCLUDE_FILES = _PAGE_FILES.format(back="0")

#: A tree of pages; every 13th includes the page that it is included by, so it is expanded where it is a root and marked as a cycle elsewhere.
TREE_FILES = _PAGE_FILES.format(back="floor((page_id - 1) / 2.0)")

GRAMMAR_REPLIES = """SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN '{"issues": []}'
  WHEN 1 THEN concat('```json', chr(10), '{"issues": [{"excerpt": "', substring(replace(split_part(coalesce(text, ''), chr(10), 1), '"', ''), 1, 8), '", "message": "m", "severity": "info"}]}', chr(10), '```')
  WHEN 2 THEN '{"issues": [{"message": "vague", "severity": "BOGUS"}, {"message": "second"}]}'
  ELSE concat('Sure: {"issues": [{"excerpt": "', chr(92), 'cite{x}", "message": "m"}]} done') END AS raw
FROM documents"""


def _spread(table: DataFrame) -> DataFrame:
    """A table that arrives in fewer pieces than there are cores (one file with one row group) is dealt out; others stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the queries above over the tables of a folder."""
    tag = uuid.uuid4().hex[:12]
    for name in TABLES:
        if f"FROM {name}" in sql:
            table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            (_spread(table) if name == "documents" else table).createOrReplaceTempView(f"{name}_{tag}")
            sql = sql.replace(f"FROM {name}", f"FROM {name}_{tag}")
    return spark.sql(sql)
