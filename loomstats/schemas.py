"""Schemas of the raw inputs."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()

# Field names of the event files.
EVENT_FIELDS = _fields(
    sessionId=_S, timestamp=_S, eventType=_S, languageId=_S, charsAdded=_L, charsDeleted=_L, acceptedCharacters=_L,
    modelName=_S, latencyMs=_D, isPartialAccept=_B, filePath=_S, isSubagent=_B, intent=_S, signalType=_S, actor=_S,
    phase=_S, rawText=_S, success=_B,
)

CATALOG_FIELDS = _fields(
    chat_uri=_S, parent_chat=_S, provider_data=_S, metadata=_S, origin=_S, tombstoned=T.IntegerType()
)
