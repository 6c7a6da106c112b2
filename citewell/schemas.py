"""Explicit schemas of inputs and index tables; nothing is inferred."""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRINGS = T.ArrayType(S)
DOCUMENT = _struct(doc_id=S, title=S, text=S, source=S, metadata=T.MapType(S, S))
GOLDEN = _struct(question=S, expected_doc=S, must_contain=STRINGS, expect_no_answer=B, expect_blocked=B)
EVENT = _struct(event_id=L, ts=T.TimestampType(), user_id=L, event_type=S, value=D, props=S)
TRIPLE = _struct(tenant_id=S, subject=S, subject_norm=S, predicate=S, object=S, object_norm=S, doc_id=S, chunk_id=S, bucket=I)
