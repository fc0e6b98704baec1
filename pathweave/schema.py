"""Schemas and names of the tables. Ids are LONG: source ids are unsigned 32 bit and do not fit INT; id 0 is reserved."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType


def _table(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


VERTEXES = _table(("id", LongType()), ("title", StringType()), ("is_redirect", BooleanType()))
EDGES = _table(("src", LongType()), ("dst", LongType()))
LINKS = _table(("src", LongType()), ("dest_title", StringType()))
REDIRECTS = _table(("from_id", LongType()), ("to_id", LongType()))
PATHS = _table(("source_id", LongType()), ("target_id", LongType()), ("path", ArrayType(LongType())))
PATH_CACHE = _table(
    ("source_page_id", LongType()), ("target_page_id", LongType()), ("timestamp", TimestampType()), ("duration", DoubleType()), ("path_data", StringType()))
SEARCH_LOG = _table(("source_page_id", LongType()), ("target_page_id", LongType()), ("timestamp", TimestampType()), ("duration", LongType()))

#: Columns of the four dump tables, in their order in the text.
DUMP_COLUMNS = {
    "page": [
        ("page_id", "bigint"), ("page_namespace", "int"), ("page_title", "string"), ("page_is_redirect", "boolean"), ("page_is_new", "boolean"),
        ("page_random", "double"), ("page_touched", "string"), ("page_links_updated", "string"), ("page_latest", "bigint"), ("page_len", "bigint"),
        ("page_content_model", "string"), ("page_lang", "string"),
    ],
    "linktarget": [("lt_id", "bigint"), ("lt_namespace", "int"), ("lt_title", "string")],
    "pagelinks": [("pl_from", "bigint"), ("pl_from_namespace", "int"), ("pl_target_id", "bigint")],
    "redirect": [("rd_from", "bigint"), ("rd_namespace", "int"), ("rd_title", "string"), ("rd_interwiki", "string"), ("rd_fragment", "string")],
}

DUMP_JOBS = ["redirecttable", "pagetable", "pagepropstable", "pagelinkstable", "linktargettable"]
_JOB = "struct<status:string,updated:string,files:map<string,struct<size:bigint,url:string,md5:string,sha1:string>>>"
DUMP_STATUS = f"version string, jobs struct<{','.join(f'{job}:{_JOB}' for job in DUMP_JOBS)}>"
TOP_PAGES = "items array<struct<project:string,access:string,year:string,month:string,day:string,articles:array<struct<article:string,views:bigint,rank:int>>>>"
PAGE_INFO = "query struct<pages:map<string,struct<pageid:bigint,ns:int,title:string,missing:string>>>"
