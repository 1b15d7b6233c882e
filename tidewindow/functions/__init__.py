"""Column functions on vectors."""

from .vectors import (
    cosine, cosine_distance, dequantize, dot, euclidean, euclidean_sq, euclidean_sq_by_norms, int8_cosine, int8_dot, int8_euclidean_sq, norm, quantize,
)

__all__ = [
    "cosine", "cosine_distance", "dequantize", "dot", "euclidean", "euclidean_sq", "euclidean_sq_by_norms", "int8_cosine", "int8_dot", "int8_euclidean_sq", "norm", "quantize",
]
