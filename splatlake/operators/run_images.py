"""Run algebra on many images at once.

The runs of an image (a mask or a frame) are intervals on one line: image after image, row after row,
with a gap between rows, so that one sort serves all images of a batch and nothing is rasterised.
An image's runs arrive together and in order; a task holds one batch of images, never a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

BATCH_RUNS = 100_000


class Lines:
    """Places of runs of ``width`` x ``height`` images on the line; intervals are half-open (p0, p1) arrays."""

    def __init__(self, width: int, height: int):
        self.width, self.height, self.stride = width, height, width + 2

    def place(self, image, y, x0, x1):
        """Intervals of the runs, cut to the image, with the rows of ``image`` and ``y`` that are left."""
        x0, x1 = np.maximum(x0, 0), np.minimum(x1, self.width)
        fits = (x0 < x1) & (y >= 0) & (y < self.height)
        base = (image[fits] * self.height + y[fits]) * self.stride
        return base + x0[fits], base + x1[fits]

    def image(self, p0):
        return p0 // (self.stride * self.height)

    def runs(self, p0, p1):
        """(image, y, x0, x1) of intervals."""
        row = p0 // self.stride
        return row // self.height, row % self.height, p0 - row * self.stride, p1 - row * self.stride

    def dilate(self, image, y, x0, x1, radius):
        """Union of the runs grown by ``radius`` (one per run) in both directions."""
        lo, hi = np.maximum(y - radius, 0), np.minimum(y + radius, self.height - 1)
        times = np.where(x0 < x1, np.maximum(hi - lo + 1, 0), 0)
        at = np.repeat(np.arange(len(y)), times)
        rows = lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        return union(*self.place(image[at], rows, (x0 - radius)[at], (x1 + radius)[at]))

    def erode(self, p0, p1, radius):
        """Erosion of disjoint intervals; the border does not erode.

        A row of the result is where all rows around it, shortened by ``radius``, lie on each other.
        """
        image, y, x0, x1 = self.runs(p0, p1)
        x0, x1 = np.where(x0 == 0, 0, x0 + radius), np.where(x1 == self.width, self.width, x1 - radius)
        image, y, x0, x1 = (a[x0 < x1] for a in (image, y, x0, x1))
        at = np.repeat(np.arange(len(y)), 2 * radius + 1)
        rows = y[at] + np.tile(np.arange(-radius, radius + 1), len(y))
        s, e, n = cover([self.place(image[at], rows, x0[at], x1[at])], [1])
        at_y = s // self.stride % self.height
        need = np.minimum(at_y + radius, self.height - 1) - np.maximum(at_y - radius, 0) + 1
        return union(s[n == need], e[n == need])

    def components(self, p0, p1):
        """Number of the first interval of the 8-connected component of each disjoint interval (sorted)."""
        lo = np.searchsorted(p1, p0 + self.stride, "left")
        hi = np.searchsorted(p0, p1 + self.stride, "right")
        below = p0 // self.stride % self.height < self.height - 1
        times = np.where(below, np.maximum(hi - lo, 0), 0)
        a = np.repeat(np.arange(len(p0)), times)
        b = lo[a] + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
        label = np.arange(len(p0))
        while len(a):
            la, lb = label[a], label[b]
            open_ = la != lb
            if not open_.any():
                break
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        return label

    def gaps(self, p0, p1, images: int):
        """Spaces in the rows from the first to the last one of each image, and whether each meets the outside."""
        y = p0 // self.stride % self.height
        image = self.image(p0)
        first, last = np.full(images, self.height), np.full(images, -1)
        np.minimum.at(first, image, y)
        np.maximum.at(last, image, y)
        times = np.maximum(last - first + 1, 0)
        which = np.repeat(np.arange(images), times)
        rows = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        base = (which * self.height + rows) * self.stride
        s = np.concatenate([base, base + self.width, p0])
        e = np.concatenate([base, base + self.width, p1])
        order = np.argsort(s, kind="stable")
        g0, g1 = e[order][:-1], s[order][1:]
        real = (g0 < g1) & (g0 // self.stride == g1 // self.stride)
        g0, g1 = g0[real], g1[real]
        at, gy, x0, x1 = self.runs(g0, g1)
        return g0, g1, (gy == first[at]) | (gy == last[at]) | (x0 == 0) | (x1 == self.width)

    def clean(self, p0, p1, images: int, keep: int, ratio: float, smallest: int, max_hole: int):
        """Largest components with small holes filled, and the summary of each image (arrays by image)."""
        image, size = self.image(p0), p1 - p0
        total = np.bincount(image, size, images).astype(np.int64)
        ids, inverse = np.unique(self.components(p0, p1), return_inverse=True)
        owner, areas = image[ids], np.bincount(inverse, size, len(ids)).astype(np.int64)
        order = np.lexsort((-ids, -areas, owner))
        count = np.bincount(owner, minlength=images)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids)) - (np.cumsum(count) - count)[owner[order]]
        minimum = np.maximum(smallest, np.rint(total * ratio).astype(np.int64))
        chosen = (rank < keep) & (areas >= minimum[owner])
        largest = np.zeros(images, dtype=np.int64)
        np.maximum.at(largest, owner, areas)
        p0, p1 = p0[chosen[inverse]], p1[chosen[inverse]]
        holes, pixels = np.zeros(images, dtype=np.int64), np.zeros(images, dtype=np.int64)
        if max_hole > 0 and len(p0):
            g0, g1, outside = self.gaps(p0, p1, images)
            hid, at = np.unique(self.components(g0, g1), return_inverse=True)
            area = np.bincount(at, g1 - g0, len(hid)).astype(np.int64)
            fill = (np.bincount(at, outside, len(hid)) == 0) & (area <= max_hole)
            hole_image = self.image(g0[hid])
            holes = np.bincount(hole_image[fill], minlength=images)
            pixels = np.bincount(hole_image[fill], area[fill], images).astype(np.int64)
            p0, p1 = union(np.concatenate([p0, g0[fill[at]]]), np.concatenate([p1, g1[fill[at]]]))
        return p0, p1, {
            "component_count": count, "largest_component_ratio": largest / np.maximum(total, 1),
            "kept_component_count": np.bincount(owner[chosen], minlength=images),
            "filled_hole_count": holes, "filled_hole_pixels": pixels,
        }


def union(p0, p1):
    """Disjoint intervals in order; touching ones merge."""
    if not len(p0):
        return p0, p1
    order = np.argsort(p0, kind="stable")
    s, reach = p0[order], np.maximum.accumulate(p1[order])
    new = np.r_[True, s[1:] > reach[:-1]]
    return s[new], reach[np.r_[new[1:], True]]


def cover(parts, weights):
    """Segments between all ends of the intervals of ``parts`` and the summed weight on each."""
    at = np.concatenate([a for p in parts for a in p])
    step = np.concatenate([np.full(len(p0), sign * w) for (p0, _), w in zip(parts, weights) for sign in (1, -1)])
    order = np.argsort(at, kind="stable")
    at, n = at[order], np.cumsum(step[order])
    long = at[1:] > at[:-1]
    return at[:-1][long], at[1:][long], n[:-1][long]


def subtract(a, b):
    """Pixels of the disjoint intervals ``a`` outside the disjoint intervals ``b``."""
    s, e, n = cover([a, b], [1, 2])
    return s[n == 1], e[n == 1]


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each group of equal keys; nulls are equal."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        c = table.column(k).combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def by_image(rows: DataFrame, keys: list[str], order: list, work: Callable, schema: str, fold: Callable | None = None,
             carry: str | None = None, most: int | None = None) -> DataFrame:
    """``work(image, columns, images)`` over batches of whole images; ``keys`` name an image.

    ``columns`` holds the other columns as arrays and ``image`` the image of each row from 0; the result
    is (image of each output row, columns).  ``fold`` shortens the rows of an image that is longer than a batch.
    ``carry`` names a column of any type, given back as the numbers of the rows whose value it takes;
    ``most`` limits the images of one call.
    """
    others = [c for c in rows.columns if c not in (*keys, carry)]
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def apply(table: pa.Table, function: Callable) -> pa.Table:
        first = _changes(table, keys)
        image = np.repeat(np.arange(len(first)), np.diff(np.r_[first, table.num_rows]))
        columns = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in others}
        at, made = function(image, columns, len(first))
        if carry in made:
            made[carry] = table.column(carry).combine_chunks().take(pa.array(made[carry]))
        names = table.select(keys).take(pa.array(first[at]))
        return pa.table([*names.columns, *[v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]], [*keys, *made])

    def made_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ends = [0, table.num_rows] if most is None else [*_changes(table, keys)[::most], table.num_rows]
        for lo, hi in zip(ends, ends[1:]):
            yield from apply(table.slice(lo, hi - lo), work).to_batches(BATCH_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held, limit = [], 0, BATCH_RUNS
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows_held += batch.num_rows
            if rows_held >= limit:
                table = pa.concat_tables(held).combine_chunks()
                last = int(_changes(table, keys)[-1])
                if last:
                    yield from made_of(table.slice(0, last))
                rest = table.slice(last)
                if fold is not None and rest.num_rows >= BATCH_RUNS:
                    rest = apply(rest, fold).cast(table.schema)
                held, rows_held, limit = [rest], rest.num_rows, rest.num_rows + BATCH_RUNS
        if held:
            yield from made_of(pa.concat_tables(held).combine_chunks())

    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{types}, {schema}")
