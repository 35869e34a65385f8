"""The engine's tables.  Schemas are constants; nothing is inferred."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

FILES = _struct(("relative_path", S), ("content", S), ("extension", S), ("is_code", B), ("content_hash", S))
POSTINGS = _struct(("field", S), ("token", S), ("relative_path", S), ("tf", I), ("positions", T.ArrayType(I)))
FIELD_STATS = _struct(("field", S), ("relative_path", S), ("len", I))
VECTORS = _struct(("relative_path", S), ("chunk_idx", I), ("off", L), ("len", L), ("text", S), ("embedding", T.ArrayType(T.FloatType())))
IMPORTS = _struct(("relative_path", S), ("extension", S), ("specifier", S), ("kind", S), ("pos", I))
EDGES = _struct(("src", S), ("dst", S))
TRIES = _struct(("candidate", S), ("relative_path", S))
MANIFEST = _struct(("relative_path", S), ("content_hash", S))
FS_EVENTS = _struct(("ts", T.TimestampType()), ("root", S), ("path", S), ("kind", S))
#: kind ``path``: a path of a burst that has ended; kind ``pending``: how many paths of the root wait now.
LIVE = _struct(("root", S), ("kind", S), ("begin", T.TimestampType()), ("end", T.TimestampType()), ("path", S), ("n_events", L), ("pending", L))
