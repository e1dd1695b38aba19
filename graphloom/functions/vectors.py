"""Vector functions as column expressions. Vectors are arrays of float or double; arithmetic is in double."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest 32-bit float, which stands for "no edge", and the parameters of the mock embedding.
FLOAT_MAX = 3.4028234663852886e38
HASH_START, HASH_FACTOR, VALUE_FACTOR, VALUE_RANGE = 5381, 33, 2654435761, 10000
#: Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
TWO64 = 1 << 64


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


#: Embedding models with their dimension (0: to be given) and whether they take images.
EMBEDDING_MODELS = {"nomic-ai/nomic-embed-text-v1.5": (768, False), "BAAI/bge-small-en-v1.5": (384, False), "sentence-transformers/all-MiniLM-L6-v2": (384, False), "openai/clip-vit-base-patch32": (512, True)}


def model_dimension(name: Column) -> Column:
    """The dimension of a known embedding model, 0 for others."""
    return F.coalesce(F.create_map(*(F.lit(x) for k, (n, _) in EMBEDDING_MODELS.items() for x in (k, n)))[name], F.lit(0))


def takes_images(name: Column) -> Column:
    """Whether an embedding model takes images; unknown ones may."""
    return F.coalesce(F.create_map(*(F.lit(x) for k, (_, y) in EMBEDDING_MODELS.items() for x in (k, y)))[name], F.lit(True))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 if the dimensions differ or a norm is 0."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), 0.0).otherwise(dot(a, b) / length)


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine to one fixed vector, whose products are unrolled into the generated code."""
    own = sum(x * x for x in query) ** 0.5
    if own == 0:
        return F.lit(0.0)
    products = F.lit(0.0)
    for k, x in enumerate(query):
        products = products + v[k].cast("double") * F.lit(float(x))
    length = norm(v) * F.lit(own)
    return F.when((F.size(v) != len(query)) | (length == 0), 0.0).otherwise(products / length)


def euclidean(a: Column, b: Column) -> Column:
    """FLOAT_MAX if the dimensions differ."""
    squares = total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))
    return F.when(F.size(a) != F.size(b), FLOAT_MAX).otherwise(F.sqrt(squares))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    length = norm(v)
    return F.when(length == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / length))


def is_normalized(v: Column) -> Column:
    return F.abs(norm(v) - 1) < 1e-6


def to_distance(similarity: Column) -> Column:
    return F.when(similarity <= 0, FLOAT_MAX).otherwise(1 / similarity)


def to_similarity(distance: Column) -> Column:
    return F.when(distance <= 0, 1.0).when(distance >= FLOAT_MAX, 0.0).otherwise(1 / distance)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _unsigned(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(38,0)")


def _mod64(x: Column) -> Column:
    return (x % _unsigned(TWO64)).cast("decimal(38,0)")


#: Bytes of a text that are hashed at once, and the powers of the factor for them.
PIECE = 1 << 16
_POWERS = np.cumprod(np.full(PIECE + 1, HASH_FACTOR, np.uint64), dtype=np.uint64) * np.uint64(pow(HASH_FACTOR, -1, TWO64))


def hash_bytes(data: bytes) -> int:
    """h = 33 h + byte, modulo 2^64: a sum of bytes by powers of 33."""
    h = HASH_START
    for at in range(0, len(data), PIECE):
        part = np.frombuffer(data, np.uint8, min(PIECE, len(data) - at), at).astype(np.uint64)
        h = (h * int(_POWERS[len(part)]) + int(np.dot(part, _POWERS[: len(part)][::-1]))) % TWO64
    return h


def fnv1a_bytes(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & (TWO64 - 1)
    return h


def _hashed(text: Column, hashed: Callable[[bytes], int]) -> Column:
    """A hash of each text's UTF-8 bytes as decimal(38,0), in Arrow batches: a fold over bytes in the JVM makes objects of each."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([str(hashed(x.as_buffer().to_pybytes())) if x.is_valid else None for x in texts], pa.string())

    return F.arrow_udf(run, "string")(text.cast("string")).cast("decimal(38,0)")


def text_hash(text: Column) -> Column:
    """The unsigned 64-bit hash h = 33 h + byte of a text, as decimal(38,0)."""
    return _hashed(text, hash_bytes)


def fnv1a(text: Column) -> Column:
    """The unsigned 64-bit FNV-1a hash of a text, as decimal(38,0)."""
    return _hashed(text, fnv1a_bytes)


def mock_embedding(text: Column, dimension: int) -> Column:
    """A deterministic unit vector of a text: component i is ((hash + i) * VALUE_FACTOR mod 2^64 mod 10000) / 10000 - 0.5, normalised."""
    def values(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (_mod64((_mod64(h + i.cast("decimal(38,0)")).cast("decimal(20,0)") * F.lit(str(VALUE_FACTOR)).cast("decimal(10,0)")).cast("decimal(38,0)")) % VALUE_RANGE).cast("double") / VALUE_RANGE - 0.5)

    # in an array, so that the hash is made once and not for each component
    return F.transform(F.transform(F.array(text_hash(text)), values), normalize)[0]
