"""Tensor operations: vectors as array columns, inside the JVM, and dense arrays of any shape on numpy, for use in
pandas UDFs or on the driver. x / 0 is 0; the shorter last dimension is repeated over the others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(_double(a), _double(b), f)


def add(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: F.when(y == 0, 0.0).otherwise(x / F.when(y == 0, 1.0).otherwise(y)))


def total(a: Column) -> Column:
    return F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def argmax(a: Column) -> Column:
    """Place of the first greatest item, from 0; -1 of an empty vector."""
    return (F.coalesce(F.array_position(a, F.array_max(a)), F.lit(0)) - 1).cast("long")


def _each(f):
    return lambda a: F.transform(_double(a), f)


relu = _each(lambda x: F.greatest(x, F.lit(0.0)))
sigmoid = _each(lambda x: 1 / (1 + F.exp(-x)))
tanh = _each(F.tanh)
silu = _each(lambda x: x / (1 + F.exp(-x)))
gelu = _each(lambda x: 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(a: Column) -> Column:
    return _let(_double(a), lambda v: _let(F.array_max(v), lambda m: _let(F.transform(v, lambda x: F.exp(x - m)), lambda e: _let(total(e), lambda s: F.transform(e, lambda x: x / s)))))


def layer_norm(a: Column, epsilon: float = 1e-5) -> Column:
    def of(v: Column) -> Column:
        centred = _let(mean(v), lambda m: F.transform(v, lambda x: x - m))
        return _let(centred, lambda c: _let(F.sqrt(mean(F.transform(c, lambda x: x * x)) + epsilon), lambda s: F.transform(c, lambda x: x / s)))

    return _let(_double(a), of)


class Arrays:
    """The same on dense arrays of any shape, and what needs more than one dimension."""

    @staticmethod
    def divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
        return np.divide(a, b, out=np.zeros(a.shape), where=b != 0)

    @staticmethod
    def matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.asarray(a, float) @ np.asarray(b, float)

    @staticmethod
    def softmax(a: np.ndarray) -> np.ndarray:
        e = np.exp(a - np.max(a, axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    @staticmethod
    def layer_norm(a: np.ndarray, gain: np.ndarray | float = 1.0, bias: np.ndarray | float = 0.0, epsilon: float = 1e-5) -> np.ndarray:
        m, v = a.mean(axis=-1, keepdims=True), a.var(axis=-1, keepdims=True)
        return (a - m) / np.sqrt(v + epsilon) * gain + bias

    @staticmethod
    def batch_norm(a: np.ndarray, gain: np.ndarray, bias: np.ndarray, mean_: np.ndarray, var: np.ndarray, epsilon: float = 1e-5) -> np.ndarray:
        """Images as (n, channels, rows, columns); one value a channel of each other argument."""
        by = lambda x: np.asarray(x, float)[None, :, None, None]
        return (a - by(mean_)) / np.sqrt(by(var) + epsilon) * by(gain) + by(bias)

    @staticmethod
    def conv2d(a: np.ndarray, kernels: np.ndarray, stride: int = 1, pad: int = 0) -> np.ndarray:
        """a: (n, channels, rows, columns); kernels: (out, channels, rows, columns)."""
        a = np.pad(a, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
        view = np.lib.stride_tricks.sliding_window_view(a, kernels.shape[2:], axis=(2, 3))[:, :, ::stride, ::stride]
        return np.einsum("nchwij,ocij->nohw", view, kernels)

    @staticmethod
    def max_pool(a: np.ndarray, size: int, stride: int | None = None) -> np.ndarray:
        s = stride or size
        return np.lib.stride_tricks.sliding_window_view(a, (size, size), axis=(2, 3))[:, :, ::s, ::s].max(axis=(-2, -1))

    @staticmethod
    def embedding(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.asarray(table)[np.asarray(ids)]
