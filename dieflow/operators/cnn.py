"""CNN scoring of maps: model files, preprocessing and a NumPy forward pass as a batch map."""

from __future__ import annotations

import math
import struct
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dieflow.patterns import PATTERNS

SIDE, CLASSES = 64, len(PATTERNS)
#: Fixed values: (in, out) channels of the convolutions; a pooling follows every second one.
CONVS = ((3, 32), (32, 32), (32, 64), (64, 64), (64, 128), (128, 128), (128, 256), (256, 256))
MAGIC, VERSION = b"WAFERCNN", 1


class ModelError(ValueError):
    pass


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Model:
    """Weights (out, in, 3, 3) and biases of the convolutions, and of the last layer (classes, 256)."""

    convs: list[tuple[np.ndarray, np.ndarray]]
    weight: np.ndarray
    bias: np.ndarray
    sha256: bytes = bytes(32)
    made: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": {}}  # it is made again where it is needed

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = []
        for i, o in CONVS:
            out += [(o, i, 3, 3), (o,)]
        return [*out, (CLASSES, CONVS[-1][1]), (CLASSES,)]

    @staticmethod
    def parse(data: bytes) -> Model:
        head = struct.Struct("<8sIIQ32s")
        if len(data) < head.size:
            raise ModelError(f"{len(data)} bytes are too few for a model's header")
        magic, version, count, checksum, sha256 = head.unpack_from(data)
        body, want = data[head.size :], Model.shapes()
        for right, why in (
            (magic == MAGIC, f"begins with {magic!r} and not with {MAGIC!r}"),
            (version == VERSION, f"has format version {version}; only {VERSION} can be read"),
            (fnv1a64(body) == checksum, "its bytes don't give the checksum in its header"),
            (count == len(want), f"has {count} tensors in place of {len(want)}"),
        ):
            if not right:
                raise ModelError(why)
        tensors, at = [], 0
        for k, shape in enumerate(want):
            end = at + 20 + 4 * math.prod(shape)
            if end > len(body):
                raise ModelError(f"ends within tensor {k}")
            rank, *sizes = struct.unpack_from("<5I", body, at)
            if tuple(sizes[:rank]) != shape:
                raise ModelError(f"tensor {k} has sizes {sizes[:rank]} in place of {list(shape)}")
            tensors.append(np.frombuffer(body[at + 20 : end], dtype="<f4").reshape(shape))
            at = end
        if at < len(body):
            raise ModelError(f"goes on for {len(body) - at} bytes after its tensors")
        return Model([(tensors[2 * k], tensors[2 * k + 1]) for k in range(len(CONVS))], tensors[-2], tensors[-1], sha256)

    def serialize(self) -> bytes:
        payload = b"".join(struct.pack("<5I", t.ndim, *t.shape, *[0] * (4 - t.ndim)) + t.astype("<f4").tobytes() for t in self.tensors())
        return MAGIC + struct.pack("<IIQ", VERSION, len(Model.shapes()), fnv1a64(payload)) + self.sha256 + payload

    def tensors(self) -> list[np.ndarray]:
        return [*(t for c in self.convs for t in c), self.weight, self.bias]


def fold_batch_norm(weight, bias, gamma, beta, mean, var, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """A convolution that does what the convolution and the batch norm after it did."""
    scale = gamma / np.sqrt(var + eps)
    return (weight * scale[:, None, None, None]).astype(np.float32), ((bias - mean) * scale + beta).astype(np.float32)


@lru_cache(maxsize=1024)
def nearest(n: int) -> np.ndarray:
    """Source index of each of the 64 places, with the inverse of the inverse scale as in a resize."""
    step = 1.0 / (float(SIDE) / n)
    return np.minimum(np.floor(np.arange(SIDE) * step).astype(np.int64), n - 1)


def preprocess(bins: np.ndarray) -> np.ndarray:
    """(maps, 3, 64, 64): off the wafer, pass, fail."""
    m, rows, cols = bins.shape
    small = np.minimum(bins[:, nearest(rows)][:, :, nearest(cols)], 2)
    return (small[:, None] == np.arange(3)[None, :, None, None]).astype(np.float32)


def conv_relu(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """3x3, one place of zero padding, then ReLU; (maps, channels, height, width) in and out."""
    return _conv_relu(x.transpose(2, 3, 0, 1), weight, bias).transpose(2, 3, 0, 1)


# Within the network arrays are (height, width, maps, channels): rows, columns and tiles are then cut without copies, and the last two axes lie together.


def _padded(x: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.zeros((height + 2, width + 2, *x.shape[2:]), dtype=np.float32)
    out[1 : x.shape[0] + 1, 1 : x.shape[1] + 1] = x
    return out


def _conv_relu(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Nine taps side by side and one product, some rows at a time."""
    h, w, m, c = x.shape
    pad, flat = _padded(x, h, w), np.ascontiguousarray(weight.transpose(2, 3, 1, 0)).reshape(9 * c, -1)
    step = max(1, ROOM // (w * m * c * 9))
    out = np.empty((h, w, m, len(weight)), dtype=np.float32)
    for at in range(0, h, step):
        y = out[at : at + step]
        taps = np.empty((len(y), w, m, 3, 3, c), dtype=np.float32)
        for i, j in np.ndindex(3, 3):
            taps[:, :, :, i, j] = pad[at + i : at + i + len(y), j : j + w]
        np.matmul(taps.reshape(-1, 9 * c), flat, out=y.reshape(-1, len(weight)))
        y += bias
        np.maximum(y, 0, out=y)
    return out


#: Winograd's F(4x4, 3x3): 36 products give the 16 results of a tile, for which the taps take 144.
TILE = 4
_OF_WEIGHTS = np.array([[1 / 4, 0, 0], [-1 / 6, -1 / 6, -1 / 6], [-1 / 6, 1 / 6, -1 / 6], [1 / 24, 1 / 12, 1 / 6], [1 / 24, -1 / 12, 1 / 6], [0, 0, 1]])
#: Floats of a stretch that is worked on at once: it should stay in a core's cache.
ROOM = 1 << 18
#: Maps that go through the convolutions before the second pooling at once; their arrays are the largest.
FEW = 32

# In tiles, arrays are (row within a tile, row of tiles, column within a tile, column of tiles, maps, channels), with a row of zero tiles before and
# after: the first rows, say, of all tiles then lie together, and so do the columns.


def tile_weights(weight: np.ndarray) -> np.ndarray:
    """Weights (out, in, 3, 3) for conv_relu_by_tiles: (6, 6, in, out), columns first."""
    both = _OF_WEIGHTS @ weight.astype(np.float64) @ _OF_WEIGHTS.T
    return np.ascontiguousarray(both.transpose(3, 2, 1, 0).astype(np.float32))


_kept = threading.local()


def _floats(n: int) -> np.ndarray:
    """Zeros that begin at a cache line."""
    whole = np.empty(max(n + 16, 1 << 20), dtype=np.float32)  # of 4 MB and more NumPy asks for large pages
    at = -whole.ctypes.data // 4 % 16
    whole[at : at + n] = 0
    return whole[at : at + n]


def _room(name: str, *shape: int) -> np.ndarray:
    """Room that a thread keeps from call to call, with whatever was left in it."""
    rooms, n = _kept.__dict__, math.prod(shape)
    if name not in rooms or len(rooms[name]) < n:
        rooms[name] = _floats(n)
    return rooms[name][:n].reshape(shape)


def _no_tiles(high: int, wide: int, *maps_and_channels: int) -> np.ndarray:
    shape = (TILE, high + 2, TILE, wide, *maps_and_channels)
    return _floats(math.prod(shape)).reshape(shape)


def _kept_tiles(name: str, *sizes: int) -> np.ndarray:
    """Tiles that a thread keeps, as long as their sizes don't change: only the zero tiles are still so."""
    tiles = _kept.__dict__.setdefault("tiles", {})
    if name not in tiles or tiles[name][0] != sizes:
        tiles[name] = sizes, _no_tiles(*sizes)
    return tiles[name][1]


def _tiles(x: np.ndarray) -> np.ndarray:
    """(height, width, maps, channels) in tiles."""
    h, w, m, c = x.shape
    high, wide = -(-h // TILE), -(-w // TILE)
    whole = x
    if (h, w) != (high * TILE, wide * TILE):
        whole = np.zeros((high * TILE, wide * TILE, m, c), dtype=np.float32)
        whole[:h, :w] = x
    out = _no_tiles(high, wide, m, c)
    out[:, 1:-1] = whole.reshape(high, TILE, wide, TILE, m, c).transpose(1, 0, 3, 2, 4, 5)
    return out


def _untiled(x: np.ndarray) -> np.ndarray:
    """Tiles as (height, width, maps, channels)."""
    n, high, _, wide, m, c = x.shape
    return x[:, 1:-1].transpose(1, 0, 3, 2, 4, 5).reshape((high - 2) * n, wide * n, m, c)


def _tile_in(d: list[np.ndarray], out: list[np.ndarray], t: np.ndarray) -> None:
    """Six rows or columns of tiles to the six that are multiplied; t is room for one."""
    a, b = out[1], out[2]
    np.subtract(d[4], d[2], out=a)
    np.subtract(d[3], d[1], out=b)
    b *= 2
    np.subtract(d[0], d[2], out=out[0])
    out[0] *= 4
    out[0] += a
    np.subtract(d[5], d[3], out=out[5])
    out[5] -= b
    out[5] -= b
    np.add(a, b, out=out[3])
    np.subtract(a, b, out=out[4])
    np.multiply(d[2], -4, out=a)
    a += d[4]
    np.multiply(d[1], -4, out=t)
    t += d[3]
    np.subtract(a, t, out=b)
    a += t


def _tile_out(m: list[np.ndarray], out: list[np.ndarray], d: np.ndarray) -> None:
    """Six rows or columns of products, which are overwritten, to the four results; d is room for one."""
    np.subtract(m[1], m[2], out=d)
    s = np.add(m[1], m[2], out=m[1])
    q = np.subtract(m[3], m[4], out=m[2])
    p = np.add(m[3], m[4], out=m[3])
    np.add(m[0], s, out=out[0])
    out[0] += p
    q *= 2
    np.add(d, q, out=out[1])
    q *= 4
    d += q
    np.add(d, m[5], out=out[3])
    p *= 4
    np.add(s, p, out=out[2])


def _parts(rows: int, size: int) -> int:
    """Into how many equal parts a product's rows are split: OpenBLAS multiplies faster where a product has at most a million multiplications."""
    return next((n for n in (1, 2, 4, 8) if rows % n == 0 and 32 <= rows // n <= 1_000_000 // size), 1)


def _conv_tiles(x: np.ndarray, tiled: np.ndarray, bias: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tiles to tiles y, some rows of tiles at a time.

    What a step reads never interleaves in memory with what it writes: NumPy would copy it.
    """
    n, high, _, wide, m, c = x.shape
    high, a, o = high - 2, n + 2, tiled.shape[-1]
    nothing = np.zeros((wide, m, o), dtype=np.float32)
    step = max(1, min(high, ROOM // (a * a * wide * m * max(c, o))))
    for at in range(0, high, step):
        k = min(step, high - at)
        rows, columns, of = _room("rows", a, k, n, wide + 2, m, c), _room("columns", a, n, k, wide, m, o), y[:, at + 1 : at + 1 + k]
        rows[:, :, :, 0] = rows[:, :, :, -1] = 0
        d = [x[(i - 1) % n, at + 1 + (i - 1) // n :][:k] for i in range(a)]
        _tile_in(d, [*rows[:, :, :, 1:-1]], _room("spare", k, n, wide, m, c))
        both, found, parts = _room("both", a, k, wide, m, c), _room("found", a, k, wide, m, o), _parts(k * wide * m, c * o)
        spare_in, spare_out = _room("spare", k, wide, m, c), _room("spare", k, wide, m, o)
        b, f, outs, ins = both.reshape(a, parts, -1, c), found.reshape(a, parts, -1, o), [*found], [*both]
        for i in range(a):
            _tile_in([rows[i, :, (j - 1) % n, 1 + (j - 1) // n :][:, :wide] for j in range(a)], ins, spare_in)
            np.matmul(b, tiled[:, i, None], out=f)
            if i == 1:
                found[1] += bias  # this product is in all results of a tile, once
            _tile_out(outs, [*columns[i]], spare_out)
        _tile_out([*columns], [*of.swapaxes(1, 2)], _room("spare", n, k, wide, m, o))
        np.maximum(of, nothing, out=of)  # an array of zeros: with the number it takes four times as long
    return y


def conv_relu_by_tiles(x: np.ndarray, tiled: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The same as _conv_relu, from tile_weights: a quarter of the multiplications."""
    tiles = _tiles(x)
    y = _no_tiles(tiles.shape[1] - 2, *tiles.shape[3:5], tiled.shape[-1])
    return _untiled(_conv_tiles(tiles, tiled, bias, y))[: x.shape[0], : x.shape[1]]


def _pool_tiles(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Pools an even number of rows and columns of tiles."""
    n = len(x)
    for i, j in np.ndindex(n, n):
        four = [x[i % 2 * 2 + a, 1 + i // 2 : -1 : 2, j % 2 * 2 + b, j // 2 :: 2] for a in range(2) for b in range(2)]
        y = out[i, 1:-1, j]
        np.maximum(four[0], four[1], out=y)
        np.maximum(y, four[2], out=y)
        np.maximum(y, four[3], out=y)
    return out


def pool(x: np.ndarray) -> np.ndarray:
    m, c, h, w = x.shape
    return x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(m, c, h // 2, 2, w // 2, 2).max(axis=(3, 5))


def _quantised(t: np.ndarray, scale: np.ndarray | float) -> np.ndarray:
    s = np.where(np.asarray(scale) == 0, 1.0, scale)
    return (np.clip(np.rint(t / s), -127, 127) * s).astype(np.float32)


def _weight(weight: np.ndarray, precision: str) -> np.ndarray:
    if precision == "fp16":
        return weight.astype(np.float16).astype(np.float32)
    if precision == "int8":
        return _quantised(weight, np.abs(weight).max(axis=(1, 2, 3), keepdims=True) / 127)
    return weight


def _weights(model: Model, precision: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights of each convolution as the precision rounds them, from the second on for tiles, and biases; made once a model and precision."""
    if precision not in model.made:
        rounded = [(_weight(weight, precision), bias) for weight, bias in model.convs]
        model.made[precision] = [rounded[0], *((tile_weights(weight), bias) for weight, bias in rounded[1:])]
    return model.made[precision]


def _rounded(x: np.ndarray, k: int, precision: str, scales: list[float] | None) -> np.ndarray:
    """What the k-th convolution takes in, as the precision rounds it."""
    if precision == "fp16":
        return x.astype(np.float16).astype(np.float32)
    return _quantised(x, scales[k - 1] / 127) if precision == "int8" and k else x


def _through(model: Model, x: np.ndarray, ks: range, precision: str, scales: list[float] | None, keep: bool = True) -> Iterator[np.ndarray]:
    """Tiles through some convolutions after the first: what comes out of each, before any pooling; what pooling leaves of the last comes last.

    With keep, they are in room that the next call takes.
    """

    def room(name: str, *sizes: int) -> np.ndarray:
        return _kept_tiles(name, *sizes) if keep else _no_tiles(*sizes)

    for k in ks:
        high, wide, m, o = x.shape[1] - 2, x.shape[3], x.shape[4], CONVS[k][1]
        x = _conv_tiles(_rounded(x, k, precision, scales), *_weights(model, precision)[k], room(f"conv{k}", high, wide, m, o))
        yield x
        if k % 2:
            x = _pool_tiles(x, room(f"pool{k}", high // 2, wide // 2, m, o))
    yield x


def layers(model: Model, x: np.ndarray, precision: str = "fp32", scales: list[float] | None = None) -> Iterator[np.ndarray]:
    """What comes out of each convolution, before any pooling; what pooling leaves of the last comes last."""
    x = _conv_relu(_rounded(np.ascontiguousarray(x.transpose(2, 3, 0, 1)), 0, precision, scales), *_weights(model, precision)[0])
    yield x.transpose(2, 3, 0, 1)
    for y in _through(model, _tiles(x), range(1, len(CONVS)), precision, scales, keep=False):
        yield _untiled(y).transpose(2, 3, 0, 1)


def _last(of: Iterator[np.ndarray]) -> np.ndarray:
    for x in of:  # each is let go before the next is made
        pass
    return x


def forward(model: Model, x: np.ndarray, precision: str = "fp32", scales: list[float] | None = None) -> np.ndarray:
    """Logits.  fp16 rounds weights and activations to halves; int8 to 127 steps of each channel's and layer's maximum."""

    def begun(at: int, to: int) -> np.ndarray:
        few = _rounded(np.ascontiguousarray(x[at:to].transpose(2, 3, 0, 1)), 0, precision, scales)
        return _last(_through(model, _tiles(_conv_relu(few, *_weights(model, precision)[0])), range(1, 2), precision, scales))

    return _finished(model, len(x), begun, precision, scales)


def _finished(model: Model, n: int, begun, precision: str, scales: list[float] | None) -> np.ndarray:
    """Logits of n maps; begun gives tiles of some of them as the first pooling leaves them."""
    x = _kept_tiles("joined", SIDE // 4 // TILE, SIDE // 4 // TILE, n, CONVS[4][0])
    for at in range(0, n, FEW):
        to = min(n, at + FEW)
        x[:, :, :, :, at:to] = _last(_through(model, begun(at, to), range(2, 4), precision, scales))
    x = _last(_through(model, x, range(4, len(CONVS)), precision, scales))
    return x[:, 1:-1].mean(axis=(0, 1, 2, 3)) @ model.weight.T + model.bias


# A map is stretched to 64 x 64 places.  The second convolution sees 5 x 5 of them, and of a map of up to 32 x 32 dies these show at most 3 x 3.
# So its result at a place is looked up under those dies and the way they lie in the 5 x 5; it is found by the plain convolutions where it first occurs.


@lru_cache(maxsize=1024)
def _seen(n: int) -> tuple[np.ndarray, list[tuple[int, ...]]] | None:
    """Sources that the five places around each place show, (3, 64) with n for none, and which of the three each of the five shows, -1 outside the map.  None if some show more."""
    source, shown, ways = nearest(n).tolist(), np.full((3, SIDE), n), []
    for k in range(SIDE):
        five = [source[p] if 0 <= p < SIDE else -1 for p in range(k - 2, k + 3)]
        own = sorted({*five} - {-1})
        if len(own) > 3:
            return None
        shown[: len(own), k] = own
        ways.append(tuple(own.index(p) if p >= 0 else -1 for p in five))
    return shown, ways


@lru_cache(maxsize=1)
def _ways() -> dict[tuple[int, ...], int]:
    """All ways to lie, numbered."""
    return {way: k for k, way in enumerate(sorted({w for n in range(1, SIDE + 1) if _seen(n) for w in _seen(n)[1]}))}


#: Results that are kept, 128 bytes each; when there are more they are begun anew.  FEW maps have fewer.
CONTEXTS = 1 << 18
_DIES = 3**9


class Contexts:
    """Results of the first two convolutions, by what they see."""

    def __init__(self, model: Model, precision: str, scales: list[float] | None):
        (first, self.first_bias), (second, self.second_bias) = ((_weight(w, precision), b) for w, b in model.convs[:2])
        self.first, self.second = (w.transpose(2, 3, 1, 0).reshape(-1, w.shape[0]) for w in (first, second))
        self.rounded = lambda x: _rounded(x, 1, precision, scales)
        self.places = np.zeros(len(_ways()) ** 2 * _DIES, dtype=np.int32)  # 0: not known
        self.results, self.known = np.empty((CONTEXTS, CONVS[1][1]), dtype=np.float32), 1

    @staticmethod
    def of(model: Model, precision: str, scales: list[float] | None) -> Contexts:
        key = (precision, scales[0] if precision == "int8" else None)
        if key not in model.made:
            model.made[key] = Contexts(model, precision, scales)
        return model.made[key]

    def found(self, keys: np.ndarray) -> np.ndarray:
        """By the plain convolutions."""
        ways = np.array([*_ways()])
        both, dies = np.divmod(keys, _DIES)
        down, across = ways[both // len(ways)], ways[both % len(ways)]
        shown = dies[:, None] // 3 ** np.arange(9) % 3
        kind = np.take_along_axis(shown, (3 * np.maximum(down, 0)[:, :, None] + np.maximum(across, 0)[:, None]).reshape(-1, 25), 1).reshape(-1, 5, 5)
        inside = (down >= 0)[:, :, None] & (across >= 0)[:, None]
        x = ((kind[..., None] == np.arange(3)) & inside[..., None]).astype(np.float32)
        taps = np.lib.stride_tricks.sliding_window_view(x, (3, 3), axis=(1, 2)).transpose(0, 1, 2, 4, 5, 3)
        y = np.maximum(np.matmul(taps.reshape(-1, 27), self.first) + self.first_bias, 0).reshape(-1, 3, 3, self.first.shape[1])
        y *= inside[:, 1:4, 1:4, None]  # the second convolution's padding is zeros too
        return np.maximum(np.matmul(self.rounded(y).reshape(len(keys), -1), self.second) + self.second_bias, 0)

    def learn(self, keys: np.ndarray) -> None:
        for at in range(0, len(keys), 4096):
            some = keys[at : at + 4096]
            self.results[self.known : self.known + len(some)] = self.found(some)
            self.places[some] = np.arange(self.known, self.known + len(some))
            self.known += len(some)

    def places_of(self, bins: np.ndarray) -> np.ndarray:
        """(64, 64, maps): where each place's result lies."""
        (down, ways_down), (across, ways_across) = _seen(bins.shape[1]), _seen(bins.shape[2])
        dies = np.zeros((bins.shape[1] + 1, bins.shape[2] + 1, len(bins)), dtype=np.int32)
        dies[:-1, :-1] = np.minimum(bins, 2).transpose(1, 2, 0)
        line = dies[:, across[0]] + 3 * dies[:, across[1]] + 9 * dies[:, across[2]]
        ways = _ways()
        lie = np.array([ways[w] for w in ways_down])[:, None] * len(ways) + np.array([ways[w] for w in ways_across])
        keys = line[down[0]] + 27 * line[down[1]] + 729 * line[down[2]] + (lie * _DIES).astype(np.int32)[:, :, None]
        places = self.places[keys]
        if not places.all():
            new = np.unique(keys[places == 0])
            if self.known + len(new) > CONTEXTS:
                self.places[:], self.known, new = 0, 1, np.unique(keys)
            self.learn(new)
            places = self.places[keys]
        return places

    def pooled(self, bins: np.ndarray) -> np.ndarray:
        """Tiles of equal-shaped maps after both convolutions and the pooling."""
        n, m, side, c = TILE, len(bins), SIDE // 2 // TILE, self.results.shape[1]
        out = _kept_tiles("begun", side, side, m, c)
        places = self.places_of(bins).reshape(side, n, 2, side, n, 2, m).transpose(1, 2, 5, 0, 4, 3, 6).astype(np.intp)
        most, other = _room("most", side, n, side, m, c), _room("other", side, n, side, m, c)
        for i in range(n):
            four = places[i].reshape(4, side, n, side, m)
            np.take(self.results, four[0], axis=0, out=most, mode="clip")
            for k in range(1, 4):
                np.take(self.results, four[k], axis=0, out=other, mode="clip")
                np.maximum(most, other, out=most)
            out[i, 1:-1] = most
        return out


def scores(model: Model, bins: np.ndarray, precision: str = "fp32", scales: list[float] | None = None) -> np.ndarray:
    """Logits of equal-shaped maps: what forward gives for them preprocessed."""
    if not (_seen(bins.shape[1]) and _seen(bins.shape[2])):
        return forward(model, preprocess(bins), precision, scales)
    contexts = Contexts.of(model, precision, scales)
    return _finished(model, len(bins), lambda at, to: contexts.pooled(bins[at:to]), precision, scales)


def activations_compared(model: Model, x: np.ndarray, precision: str, scales: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(maps, layers) twice: the largest activation of each convolution in fp32, and the largest distance from it in another precision."""
    pairs = list(zip(layers(model, x), layers(model, x, precision, scales)))[: len(model.convs)]
    return np.stack([a.max(axis=(1, 2, 3)) for a, _ in pairs], axis=1), np.stack([np.abs(a - b).max(axis=(1, 2, 3)) for a, b in pairs], axis=1)


def layer_maxima(model: Model, x: np.ndarray) -> np.ndarray:
    """(maps, layers): the largest activation after each convolution."""
    return np.stack([y.max(axis=(1, 2, 3)) for y in layers(model, x)][: len(model.convs)], axis=1)


def _scored(wafers: DataFrame, model: Model, fn, name: str, keep: tuple[str, ...], rows: int, given_as=preprocess) -> DataFrame:
    sent = wafers.sparkSession.sparkContext.broadcast(model)  # a fixed architecture: under 5 MB

    from dieflow.operators.signatures import _by_shape

    given = wafers.select(*keep, F.col("rows").cast("int").alias("__rows"), F.col("cols").cast("int").alias("__cols"), F.col("bins").alias("__bins"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                found = _by_shape(batch, len(keep), lambda maps: {"x": fn(sent.value, given_as(maps)).astype(np.float32)})
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([*found["x"]], pa.list_(pa.float32()))], names=[*keep, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[: len(keep)])
    return given.mapInArrow(run, f"{kinds}, {name} array<float>")


def logits(wafers: DataFrame, model: Model, keep: tuple[str, ...] = ("wafer_id",), precision: str = "fp32", scales: list[float] | None = None, rows: int = 32) -> DataFrame:
    """The kept columns and logits, an array of nine floats."""
    return _scored(wafers, model, lambda m, bins: scores(m, bins, precision, scales), "logits", keep, rows, lambda maps: maps)


def calibrate(wafers: DataFrame, model: Model, first: int | None = None) -> list[float]:
    """The largest activation of each convolution over the first maps by id, or all: the int8 scales."""
    given = wafers.orderBy("wafer_id").limit(first) if first else wafers
    seen = _scored(given, model, layer_maxima, "most", ("wafer_id",), 32)
    row = seen.agg(*(F.max(F.get("most", F.lit(k))) for k in range(len(CONVS)))).first()
    return [float(v or 0.0) for v in row]


def scales_text(scales: list[float]) -> str:
    return "".join(f"conv{k + 1} {v!r}\n" for k, v in enumerate(scales))


def parse_scales(text: str) -> list[float]:
    """One `layer max` line for each convolution."""
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    if len(rows) != len(CONVS) or any(len(r) != 2 for r in rows):
        raise ModelError(f"expected {len(CONVS)} lines of layer and maximum")
    return [float(r[1]) for r in rows]


@dataclass(frozen=True)
class Conformal:
    """Thresholds by class for misses of 10 and 5 %, and the confidence to accept without review."""

    model_sha256: str
    thresholds_10: tuple[float, ...]
    thresholds_05: tuple[float, ...]
    accept_confidence: float
    reported: tuple[tuple[str, tuple[float, ...]], ...] = ()

    @staticmethod
    def parse(text: str) -> Conformal:
        given: dict[tuple[str, ...], list[str]] = {}
        reported = []
        for f in (line.split() for line in text.splitlines() if not line.startswith("#")):
            names = 2 if f and f[0] in ("thresholds", "reported_coverage") else 1
            if f and f[0].startswith("reported"):
                reported.append((" ".join(f[:names]), tuple(map(float, f[names:]))))
            elif len(f) > names:
                given[tuple(f[:names])] = f[names:]
        found = {
            "sha": given.get(("model_sha256",), [None])[0],
            "10": tuple(map(float, given.get(("thresholds", "0.1"), ())[:CLASSES])),
            "05": tuple(map(float, given.get(("thresholds", "0.05"), ())[:CLASSES])),
            "accept": float(given.get(("accept_confidence",), ["nan"])[0]),
        }
        missing = [k for k, v in found.items() if v is None or v != v or isinstance(v, tuple) and len(v) < CLASSES]
        if missing:
            raise ModelError(f"the calibration lacks {', '.join(missing)}")
        return Conformal(found["sha"], found["10"], found["05"], found["accept"], tuple(reported))
