"""Views over the given tables that the queries read, in Spark's SQL and in the oracle's.

{name} stands for a table or another view. One text serves both dialects unless two are given.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PAGE_CHARS = 500

_K = {"spark": "get_json_object(props, '$.k')", "duck": "json_extract_string(props, '$.k')"}
_SERIES = {"spark": "explode(sequence(0, {0}))", "duck": "unnest(range(0, {0} + 1))"}
_PAGES = """SELECT d.doc_id, CAST(i AS INT) AS pos, CAST(i AS INT) AS page_index, d.page_count, substring(t.text, CAST(i AS INT) * 500 + 1, 500) AS payload
FROM (SELECT doc_id, page_count, %s AS i FROM {fx_docs} WHERE page_count > 0) d JOIN {documents} t ON t.doc_id = d.doc_id"""
_EDITS = """SELECT user_id AS doc_id, ts, event_id AS seq, CAST(5 + user_id %% 8 AS INT) AS n,
  CASE event_type WHEN 'click' THEN 'toggle' WHEN 'view' THEN 'move' WHEN 'purchase' THEN 'delete' WHEN 'signup' THEN 'select_all' ELSE 'reset' END AS op,
  CAST(CAST(floor(value) AS BIGINT) %% (5 + user_id %% 8) AS INT) AS a, CAST(CAST(%s AS BIGINT) %% (5 + user_id %% 8) AS INT) AS b
FROM {events}"""
_DRAGS = """SELECT seq AS gesture_id, doc_id, n, ts, seq, CAST(i AS INT) AS step, CAST((a + i * (1 + b %% 3)) %% n AS INT) AS from_pos, CAST((a + (i + 1) * (1 + b %% 3)) %% n AS INT) AS to_pos
FROM (SELECT *, %s AS i FROM {fx_edits} WHERE op = 'move') g"""

VIEWS: dict[str, str | tuple[str, str]] = {
    "fx_docs": """SELECT doc_id, n_chars, CAST(ceil(n_chars / 500.0) AS INT) AS page_count,
  concat('doc_', doc_id, CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.png' WHEN 3 THEN '.jpg' WHEN 4 THEN '' ELSE '.pdf.pdf' END) AS name,
  CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 6 IN (0, 1, 5) THEN 'application/pdf' WHEN doc_id % 6 = 2 THEN 'image/png' WHEN doc_id % 6 = 3 THEN 'image/jpeg' ELSE 'text/plain' END AS mime,
  CAST(floor(doc_id / 2.0) AS BIGINT) AS batch_id, CAST(doc_id % 2 AS INT) AS file_no,
  CASE WHEN CAST(floor(doc_id / 2.0) AS BIGINT) % 3 = 0 THEN 'select' ELSE 'drop' END AS via, doc_id % 11 = 0 AS load_failed
FROM {documents}""",
    "fx_files": "SELECT batch_id, file_no, name, mime, via, load_failed, doc_id FROM {fx_docs}",
    "fx_pages": (_PAGES % "explode(sequence(0, page_count - 1))", _PAGES % "unnest(range(0, page_count))"),
    "fx_lines": """SELECT l_orderkey AS doc_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS page_index,
  l_quantity * 20 AS width_pt, l_extendedprice / 50 AS height_pt
FROM {lineitem}""",
    "fx_set": """SELECT o.o_custkey AS set_id, CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) - 1 AS INT) AS set_pos, o.o_orderkey AS doc_id, c.page_count
FROM {orders} o JOIN (SELECT l_orderkey AS doc_id, CAST(count(*) AS INT) AS page_count FROM {lineitem} GROUP BY l_orderkey) c ON c.doc_id = o.o_orderkey""",
    "fx_edits": (_EDITS % _K["spark"], _EDITS % _K["duck"]),
    "fx_edit_docs": "SELECT DISTINCT user_id AS doc_id, CAST(5 + user_id % 8 AS INT) AS page_count, concat('doc_', user_id, '.pdf') AS name FROM {events}",
    "fx_ranges": """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat(' ', doc_id % 4) END AS start_txt,
  CASE WHEN doc_id % 8 = 0 THEN concat(doc_id % 4 + doc_id % 5 - 1, 'ab') ELSE concat('', doc_id % 4 + doc_id % 5 - 1) END AS end_txt
FROM {documents}""",
    "fx_reorder": """SELECT doc_id, page_count - 1 - page_index AS j, page_index AS src FROM {fx_pages} WHERE NOT (doc_id % 2 = 0 AND page_index = page_count - 1)
UNION ALL SELECT doc_id, page_count AS j, 0 AS src FROM {fx_docs} WHERE doc_id % 5 = 0""",
    "fx_pointer": "SELECT event_id, value AS x, value * 0.5 AS y, CAST(0.25 AS DOUBLE) * (1 + user_id % 20) AS scale FROM {events}",
    "fx_images": "SELECT p_brand AS set_id, p_partkey AS image_id, p_size * 10 AS width, CAST(floor(p_retailprice) AS INT) - 650 AS height FROM {part}",
    "fx_drags": (_DRAGS % _SERIES["spark"].format("b % 4"), _DRAGS % _SERIES["duck"].format("b % 4")),
    "fx_set_edits": """SELECT e.user_id AS set_id, e.ts, e.event_id AS seq,
  CASE e.event_type WHEN 'signup' THEN 'append' WHEN 'view' THEN 'move' WHEN 'click' THEN 'move_up'
       WHEN 'purchase' THEN CASE WHEN e.value > 60 THEN 'remove' ELSE 'append' END
       ELSE CASE WHEN e.value > 200 THEN 'clear' ELSE 'move_down' END END AS op, f.a, f.b, 7000000 - e.event_id AS doc_id
FROM {events} e JOIN {fx_edits} f ON f.seq = e.event_id""",
    # each hover of a drag as a move of its own; without deletes, so that all positions exist
    "fx_hovers": """SELECT doc_id, ts, seq, 0 AS step, op, a, b FROM {fx_edits} WHERE op NOT IN ('move', 'delete')
UNION ALL SELECT doc_id, ts, seq, step, 'move' AS op, from_pos AS a, to_pos AS b FROM {fx_drags}""",
    # every document is loaded twice
    "fx_loads": "SELECT set_id, set_pos * 2 AS set_pos, doc_id, page_count FROM {fx_set} UNION ALL SELECT set_id, set_pos * 2 + 1 AS set_pos, doc_id, page_count FROM {fx_set}",
    "fx_bad_moves": """SELECT doc_id, from_pos, to_pos + 1000 AS to_pos FROM {fx_moves} WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, from_pos, to_pos FROM {fx_moves} WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, from_pos + 1 AS from_pos, to_pos FROM {fx_moves} WHERE doc_id % 3 = 1
UNION ALL SELECT -1 - doc_id AS doc_id, from_pos, to_pos FROM {fx_moves} WHERE doc_id % 3 = 2""",
    "fx_bad_reorder": "SELECT doc_id, j, src FROM {fx_reorder} WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 99999 AS j, page_count + 3 AS src FROM {fx_docs} WHERE doc_id % 4 = 0",
    "fx_talks": "SELECT conv_id AS doc_id, CAST(turn AS INT) AS pos, CAST(turn AS INT) AS page_index, role FROM {conversations}",
    "fx_talk_docs": "SELECT conv_id AS doc_id, CAST(count(*) AS INT) AS page_count FROM {conversations} GROUP BY conv_id",
    "fx_moves": "SELECT doc_id, CAST(doc_id % page_count AS INT) AS from_pos, CAST((doc_id * 3 + 1) % page_count AS INT) AS to_pos FROM {fx_talk_docs}",
    "fx_append": "SELECT o_custkey AS set_id, year(o_orderdate) AS batch_no, o_orderkey AS file_no, o_orderkey AS doc_id, CAST(o_orderkey % 9 AS INT) AS page_count FROM {orders}",
    # typed numbers as a browser reads them: hexadecimal ones, signs, white space of Unicode
    "fx_typed": """SELECT doc_id, concat(CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE '{nbsp}' END, CASE doc_id % 4 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE '' END,
  CASE doc_id % 6 WHEN 0 THEN concat('0x1', doc_id % 10, 'g') WHEN 1 THEN '0x' WHEN 2 THEN concat('0', doc_id, 'px') WHEN 3 THEN 'x1' WHEN 4 THEN '99999999999' ELSE concat('', doc_id) END) AS typed FROM {documents}""".replace("{nbsp}", "\u00a0"),
    # edits in the batches in which they arrive: by time, every seventh a batch later, every hundredth far behind
    "fx_arrivals": """SELECT doc_id, n, ts, seq, op, a, b, CAST(CASE WHEN seq % 100 = 0 THEN 3 WHEN seq % 7 = 0 THEN least(slot + 1, 3) ELSE slot END AS INT) AS batch
FROM (SELECT *, ntile(4) OVER (ORDER BY ts, seq) - 1 AS slot FROM {fx_edits})""",
    "fx_bad_loads": "SELECT batch_id, file_no, name, load_failed, CASE WHEN batch_id % 10 = 3 THEN 3 ELSE count(*) OVER (PARTITION BY batch_id) END AS n_files FROM {fx_files}",
    "fx_zooms": "SELECT user_id AS view_id, ts, CAST(0.25 AS DOUBLE) * (1 + event_id % 20) AS scale FROM {events} WHERE event_type IN ('view', 'signup')",
    "fx_moves_of_pointer": "SELECT event_id, user_id AS view_id, ts, value AS x, value * 0.5 AS y FROM {events} WHERE event_type NOT IN ('view', 'signup')",
}
_REF = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view as a lazy DataFrame over it."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    text = text if isinstance(text, str) else text[0]
    return spark.sql(text, **{r: frame(spark, sf_dir, r) for r in dict.fromkeys(_REF.findall(text))})


def oracle(text: str) -> str:
    """The oracle's text of a query, with the views that it names in front."""
    found: dict[str, str] = {}

    def need(name: str) -> None:
        if name in VIEWS and name not in found:
            own = VIEWS[name]
            own = own if isinstance(own, str) else own[1]
            for r in _REF.findall(own):
                need(r)
            found[name] = _REF.sub(r"\1", own)

    for r in _REF.findall(text):
        need(r)
    body = _REF.sub(r"\1", text).strip()
    views = ",\n".join(f"{n} AS ({t})" for n, t in found.items())
    if not views:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE '):]}"
    return f"WITH {views},\n{body[len('WITH '):]}" if body.startswith("WITH ") else f"WITH {views}\n{body}"
