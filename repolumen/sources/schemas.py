"""Schemas of every table the package reads or writes.

Written out as types, not as DDL text: worker processes import this module too,
and parsing DDL needs a driver.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
TIMESTAMP, LOCAL_TIME = T.TimestampType(), T.TimestampNTZType()
VECTOR = T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ORIGIN = _struct(id=STRING, url=STRING)
ORIGIN_VISIT = _struct(origin=STRING, visit=INT, date=TIMESTAMP, type=STRING)
HOST_ORIGINS = _struct(url=STRING)
LAST_VISITS = _struct(origin=STRING, date=TIMESTAMP)
NUMBERED_ORIGINS = _struct(id=LONG, origin=STRING)
README_RECORD = _struct(content_hash=STRING, repo_name=STRING, content=STRING)
DATED_README_RECORD = _struct(
    content_hash=STRING, repo_name=STRING, content=STRING, last_commit=LONG
)
README_ITEM = _struct(id=STRING, repo_name=STRING, content=STRING, content_hash=STRING)
VECTOR_INDEX = _struct(id=STRING, vector=VECTOR, repo_name=STRING, content_hash=STRING)
FETCH_ATTEMPT = _struct(
    repo=STRING,
    priority=INT,
    branch=STRING,
    filename=STRING,
    status=INT,
    body=STRING,
    ms=LONG,
    ts=LOCAL_TIME,
)
FETCH_RESULT = _struct(
    repo_name=STRING,
    content=STRING,
    branch=STRING,
    filename=STRING,
    status=INT,
    candidates_tried=INT,
    fetch_ms=LONG,
)
FETCH_OUTCOME = _struct(
    repo_name=STRING,
    branch=STRING,
    filename=STRING,
    status=INT,
    candidates_tried=INT,
    outcome=STRING,
    content=STRING,
)
BATCH_ITEM = _struct(
    batch_id=STRING, created_at=LOCAL_TIME, id=STRING, repo_name=STRING, content_hash=STRING
)
BATCH_STATUS = _struct(
    id=STRING,
    status=STRING,
    output_file_id=STRING,
    error_file_id=STRING,
    request_counts=_struct(completed=LONG, failed=LONG, total=LONG),
)
BATCH_RESULT_ROW = _struct(
    id=STRING,
    custom_id=STRING,
    response=_struct(
        data=T.ArrayType(_struct(embedding=VECTOR)), usage=_struct(prompt_tokens=LONG)
    ),
)
PROGRESS = _struct(table_name=STRING, last_id=LONG, saved_at=LOCAL_TIME)
REPO_INFO = _struct(
    repo_name=STRING,
    description=STRING,
    stars=LONG,
    language=STRING,
    forks=LONG,
    fetched_at=LOCAL_TIME,
)
