"""The source tables' shapes, declared once, and the probe that holds a table against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, I, L, B, TS, D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType(), T.DoubleType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


DOCUMENT = _struct(id=S, semantic_id=S, link=S, boost=I, hidden=B, doc_updated_at=TS, last_modified=TS, last_synced=TS, chunk_count=I,
                   content_hash=S, doc_metadata=S, primary_owners=T.ArrayType(S))
ATTRIBUTION = _struct(id=S, connector_id=I, credential_id=I, has_been_indexed=B)
CONNECTOR = _struct(id=I, name=S, source=S, input_type=S, refresh_freq=I, prune_freq=I)
CC_PAIR = _struct(id=I, connector_id=I, credential_id=I, name=S, status=S, in_repeated_error_state=B)
ATTEMPT = _struct(id=L, cc_pair_id=I, status=S, error_msg=S, new_docs_indexed=I, total_docs_indexed=I, time_created=TS, time_started=TS,
                  time_updated=TS, last_heartbeat_time=TS)
CHUNK = _struct(document_id=S, chunk_index=I, content=S, blurb=S, title=S, semantic_identifier=S, source_type=S, hidden=B, last_updated=L,
                source_links=S, content_vector=T.ArrayType(T.FloatType()))
REASON = _struct(detector=S, code=S, detail=S, confidence=T.FloatType(), evidence=S)
CANDIDATE = _struct(candidate_id=L, document_id=S, connector_id=I, state=S, reasons=T.ArrayType(REASON), confidence=T.FloatType(), chunk_count=I,
                    recrawl_risk=B, scan_id=L, created_at=TS, stage_expires_at=TS, prev_hidden=B)


class SchemaMismatch(ValueError):
    """A table lacks columns that a query needs."""


def probe(df: DataFrame, want: T.StructType, name: str) -> DataFrame:
    """``df``, if it has every declared column in its type; else SchemaMismatch."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    missing = [f.name for f in want.fields if f.name not in have]
    wrong = [f"{f.name}: {have[f.name]}, not {f.dataType.simpleString()}" for f in want.fields if f.name in have and have[f.name] != f.dataType.simpleString()]
    if missing or wrong:
        raise SchemaMismatch(f"{name}: missing {missing}, wrong {wrong}")
    return df


def vector_fields(df: DataFrame, path: str = "", schema: T.StructType | None = None) -> list[str]:
    """Names of the float-array fields of a schema, nested ones by path."""
    found = []
    for f in (schema or df.schema).fields:
        at = f"{path}{f.name}"
        if isinstance(f.dataType, T.StructType):
            found += vector_fields(df, f"{at}.", f.dataType)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType)):
            found.append(at)
    return found


def has_vectors(df: DataFrame, field: str) -> bool:
    """A declared field counts as a capability only if some row fills it."""
    return field in vector_fields(df) and not df.filter(f"{field} is not null and size({field}) > 0").limit(1).isEmpty()
