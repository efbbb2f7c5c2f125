"""Inputs derived from the test tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leafmill.sources.files import load

MARKDOWN = """
select doc_id as page_id, lang, source,
  '# ' || source || chr(10) || chr(10) || 'Intro ' || lang || chr(10) || chr(10)
  || '## ' || lang || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10)
  || '![a](assets/f' || cast(doc_id as string) || '.png)' || chr(10)
  || '### deep' || chr(10) || 'n=' || cast(n_chars as string) || chr(10)
  || '## end' || chr(10) || 'last' as md
from documents"""

MANIFEST = """
select cast(floor(doc_id / 50) as bigint) as root_id, doc_id as page_id, 'Page ' || cast(doc_id as string) as title,
  case when doc_id % 11 = 0 then null else 'http://w/pages/' || cast(doc_id as string) end as web_url,
  doc_id % 4 <> 0 as markdown_extracted, doc_id % 4 >= 2 as chunked, doc_id % 4 = 3 as vector_ingested,
  case when doc_id % 5 = 0 then 'boom' when doc_id % 5 = 1 then ' ' end as last_error,
  cast(doc_id % 3 as int) as no_of_retries
from documents"""

EDGES = """
select cast(floor((page_id - 1) / 4) as bigint) as parent_id, page_id as child_id, cast((page_id - 1) % 4 as int) as position
from pages where page_id > 0"""

# Tables of 50 parts: of three one has a row of one wide cell, one a row of three cells, one neither.
TABLE_ROWS = """
select cast(floor(p_partkey / 50) as bigint) as table_id, cast(p_partkey % 50 as int) as row_ix, p_name, p_brand,
  '<tr>' || case when floor(p_partkey / 50) % 3 = 0 and p_partkey % 50 = 2 then '<td colspan="2">' || p_name || '</td>'
    else '<td>' || p_name || '</td><td>' || p_brand || ' | x</td>' || case when floor(p_partkey / 50) % 3 = 1 and p_partkey % 50 = 3 then '<td>more</td>' else '' end end || '</tr>' as tr
from part"""

ATTACHMENTS = """
select cast(floor(doc_id / 5) as bigint) as page_id, doc_id as ord,
  'f' || cast(doc_id as string) || case doc_id % 10 when 0 then '.png' when 1 then '.JPG' when 2 then '.svg'
    when 3 then '.pdf' when 4 then '.pptx' when 5 then '.vsdx' when 6 then '.drawio' when 7 then '.xml'
    when 8 then '.' else '' end as file_name,
  case when doc_id % 6 = 0 then 'application/pdf' end as declared_mime,
  case doc_id % 5 when 0 then '89504E47' when 1 then 'FFD8FFE0' when 2 then '25504446' when 3 then '504B0304'
    else '00000000' end as magic,
  case when doc_id % 7 = 0 then 'SKIPPED' else 'SUCCESS' end as status,
  case when doc_id % 5 = 0 then ' ' else 'Summary ' || lang end as summary,
  case when doc_id % 3 = 0 then 'DRAWIO_SOURCE' else 'PHOTO' end as detected_type,
  source, lang
from documents"""

# Diagrams of 50 customers around a hub, of five kinds in turn: architecture, states, boxes, tables with a column each, classes with a member each, that of the hub in its own label.
MEMBERS = """
select g, cast(g % 5 as int) as kind, c_custkey,
  case g % 5 when 0 then c_name || ' Controller' when 1 then 'WAIT ' || cast(c_custkey as string) when 2 then 'Box ' || cast(c_custkey as string) when 3 then 'Table ' || cast(c_custkey as string) else 'Item' || cast(c_custkey as string) end as label,
  case g % 5 when 0 then 'Hub ' || cast(g as string) || ' Service' when 1 then 'APPROVED ' || cast(g as string) when 2 then 'Root ' || cast(g as string) when 3 then 'Hub ' || cast(g as string) else 'Base' || cast(g as string) || '  +id: Long' end as hub,
  case g % 5 when 3 then 'c' || cast(c_custkey as string) || ' pk' when 4 then 'String name' || cast(c_custkey as string) end as child
from (select cast(floor(c_custkey / 50) as bigint) as g, c_custkey, c_name from customer) c"""

DIAGRAM_CELLS = f"""
with m as ({MEMBERS})
select g, cast(0 as bigint) as ord, '<mxCell id="n" value="' || hub || '" vertex="1" parent="1"' || case when kind = 4 then ' style="swimlane;"' else '' end || '/>' as xml from m where c_custkey % 50 = 0
union all
select g, 4 * c_custkey + 1, '<mxCell id="c' || cast(c_custkey as string) || '" value="' || label || '" vertex="1" parent="1" style="rounded=1;"/>' from m
union all
select g, 4 * c_custkey + 2, '<mxCell id="k' || cast(c_custkey as string) || '" value="' || child || '" vertex="1" parent="c' || cast(c_custkey as string) || '"/>' from m where child is not null
union all
select g, 4 * c_custkey + 3, '<mxCell id="e' || cast(c_custkey as string) || '" edge="1" parent="1"' || case when kind = 1 then ' value="approve"' else '' end || ' source="' || case when child is null then 'c' else 'k' end
  || cast(c_custkey as string) || '" target="n" style="endArrow=block;dashed=' || cast(c_custkey % 2 as string) || '"/>' from m"""

OUTCOMES = """
select user_id as root_id, event_id % 50 as page_id, event_id, ts,
  case event_type when 'view' then 'PAGE_TRANSFORM' when 'click' then 'CHUNK' else 'VECTOR_INGEST' end as phase,
  event_type <> 'error' as success
from events"""

JOBS = """
select case when event_id % 100 = 7 then null else cast(event_id as string) end as message_id, user_id as root_id, event_type as job_type, ts from events
union all
select cast(event_id as string), user_id, event_type, ts from events where event_id % 10 = 0"""

# Crawls of 500 pages that discover three pages with each processed one, until 401 are known.
TICKS = """
select cast(floor(doc_id / 500) as bigint) as root_id, doc_id % 500 as seq, doc_id % 500 as processed, least(400, 3 * (doc_id % 500)) + 1 as discovered,
  cast(doc_id as string) as page_id, source as title
from documents"""

VECTORS = "select cast(vec_id as string) as chunk_id, vec_id, cast(label as bigint) as root_id, vec_id % 200 as page_id, embedding from embeddings"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above over the tables of sf_dir."""
    words = set(sql.replace("\n", " ").replace(",", " ").replace(")", " ").split())
    used = [t for t in TABLES if t in words]
    for t in used:  # named as arguments, so that a session's own views stay as they are
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in used})
