"""Search as a table function of SQL.

``register`` makes ``kb_search(terms, who, k)`` in a session: the files that ``who`` is
granted, by occurrences of the terms, ties by doc_id, the best k. Its body is SQL that
Catalyst puts in the place of the call, so access is joined below tokenising as in the
DataFrame search. Terms and names are values, compared as they are: none of them can reach
other rows than ``who``'s own, whatever characters they hold. A null name is nobody.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from kilnworks.functions.text import SPLIT

BODY = """
CREATE OR REPLACE TEMPORARY FUNCTION {name}(terms ARRAY<STRING>, who STRING, k INT)
RETURNS TABLE (doc_id BIGINT, score BIGINT, rnk INT)
RETURN
  SELECT doc_id, score, rnk FROM (
    SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rnk FROM (
      SELECT f.doc_id, count(*) AS score
      FROM {files} f LEFT SEMI JOIN (SELECT kb FROM {acl} WHERE principal = kb_search.who) g ON f.kb = g.kb
      LATERAL VIEW explode(split(lower(coalesce(f.text, '')), '{split}')) t AS token
      WHERE token <> '' AND array_contains(kb_search.terms, token)
      GROUP BY f.kb, f.doc_id
    )
  ) WHERE rnk <= kb_search.k
"""


def register(files: DataFrame, acl: DataFrame, name: str = "kb_search") -> None:
    """Registers the function over files (doc_id, kb, text) and acl (principal, kb), which
    become views of the session."""
    spark = files.sparkSession
    views = [f"{name}_files", f"{name}_acl"]
    files.createOrReplaceTempView(views[0])
    acl.createOrReplaceTempView(views[1])
    spark.sql(BODY.format(name=name, files=views[0], acl=views[1], split=SPLIT.replace("\\", "\\\\")).replace("kb_search.", f"{name}."))
