"""Polyhedral template matching (published in 2016) over batches of neighbour lists.

A shell of nearest neighbours is described by the edge graph of its convex hull.
Graphs are compared by a canonical labelling: from a directed edge the vertices
are numbered in the order in which a walk around each numbered vertex meets
them, and the walk with the least code gives the numbers.  Templates with square
faces have a graph for each way to split the squares; those that no rotation of
the template maps to each other are listed.  Equal codes pair the neighbours
with template points, and Horn's quaternion gives the rotation and scale of the
least root mean square deviation (RMSD).

Everything works on arrays of many particles at a time; a particle's list has a
fixed length, so memory is bounded by the batch.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.operators.lists import nearest_lists

OTHER, FCC, HCP, BCC, ICO, SC, CUBIC_DIAMOND, HEX_DIAMOND, GRAPHENE = range(9)
NAMES = {OTHER: "OTHER", FCC: "FCC", HCP: "HCP", BCC: "BCC", ICO: "ICO", SC: "SC", CUBIC_DIAMOND: "CUBIC_DIAMOND", HEX_DIAMOND: "HEX_DIAMOND", GRAPHENE: "GRAPHENE"}
NO_ORDER, PURE, L10, L12_CU, L12_AU, B2, SIC, BN = range(8)
DEFAULT = (FCC, HCP, BCC)
SIZES = {FCC: 12, HCP: 12, BCC: 14, ICO: 12, SC: 6, CUBIC_DIAMOND: 16, HEX_DIAMOND: 16, GRAPHENE: 9}
#: Neighbours to list: where a second shell belongs to the first one's neighbours, a few more than the template has points.
LISTED = SIZES | {CUBIC_DIAMOND: 20, HEX_DIAMOND: 20, GRAPHENE: 12}
#: Particles that are matched at a time, and those whose hulls are computed at a time.
CHUNK, HULLS = 2048, 128
SCHEMA = "frame int, idx long, structure int, rmsd double, interatomic_distance double, qx double, qy double, qz double, qw double, deformation array<double>, ordering_type int, neighbors array<long>"


def _signs(*v: float) -> list[tuple[float, ...]]:
    return sorted(set(itertools.product(*[(-x, x) for x in v])))


def _points(kind: int) -> np.ndarray:
    g, r = (1 + 5**0.5) / 2, 8**0.5 / 3
    turn = [np.array([np.cos(a), np.sin(a), 0]) for a in 2 * np.pi / 3 * np.arange(3)]
    up = np.array([0, 0, 1.0])
    if kind == FCC:
        p = [np.roll(s, k) for k in range(3) for s in _signs(1, 1, 0)]
    elif kind == HCP:
        p = [t - u for t in turn for u in turn if t is not u] + [t + s * 2**0.5 * up for t in turn for s in (1, -1)]
    elif kind == BCC:
        p = [*_signs(0.5, 0.5, 0.5), *[s * e for e in np.eye(3) for s in (1, -1)]]
    elif kind == ICO:
        p = [np.roll(s, k) for k in range(3) for s in _signs(1, g, 0)]
    elif kind == SC:
        p = [s * e for e in np.eye(3) for s in (1, -1)]
    elif kind == CUBIC_DIAMOND:
        p = [np.array(s) / 2 for s in _signs(0.5, 0.5, 0.5) if np.prod(s) > 0]
        p += [p[a] - q for a, b in itertools.permutations(range(4), 2) for q in [p[b]]]
    elif kind == HEX_DIAMOND:
        low = [r * t - up / 3 for t in turn]
        p = [up, *low, *[up + d + 2 * up / 3 for d in low], *[x for k in range(3) for x in (low[k] - up, low[k] - low[k - 1], low[k] - low[k - 2])]]
    else:
        p = [*turn, *[turn[a] - turn[b] for a, b in itertools.permutations(range(3), 2)]]
    p = np.array(p, float)
    return p / np.linalg.norm(p, axis=1).mean()


def _rotations(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proper rotations that map a set of points to itself: matrices, and where each point goes."""
    gram = p @ p.T
    b = next(k for k in range(1, len(p)) if np.linalg.norm(np.cross(p[0], p[k])) > 1e-3)
    frame = lambda u, v: np.stack([u, v, np.cross(u, v)], 1)
    inverse, found = np.linalg.inv(frame(p[0], p[b])), []
    for i, j in itertools.permutations(range(len(p)), 2):
        if np.allclose([gram[i, i], gram[j, j], gram[i, j]], [gram[0, 0], gram[b, b], gram[0, b]], atol=1e-9):
            m = frame(p[i], p[j]) @ inverse
            d = np.linalg.norm((p @ m.T)[:, None] - p, axis=2)
            if (d.min(1) < 1e-6).all():
                found.append((m, d.argmin(1)))
    return np.array([m for m, _ in found]), np.array([k for _, k in found])


def facets(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``around`` (B, n, n) of the convex hulls of B sets of n points, and which sets have all points on a hull of triangles.

    ``around[u, v]`` is the vertex after v around u, -1 where no edge joins them.
    """
    n = p.shape[1]
    a, b, c = np.array(list(itertools.combinations(range(n), 3))).T
    normal = np.cross(p[:, b] - p[:, a], p[:, c] - p[:, a])
    side = normal @ p.transpose(0, 2, 1)
    side -= np.take_along_axis(side, np.broadcast_to(a[:, None], (len(p), len(a), 1)), 2)
    t = np.arange(len(a))
    side[:, t, a] = side[:, t, b] = side[:, t, c] = 0
    below, above = (side <= 0).all(2), (side >= 0).all(2)
    good = ((below ^ above).sum(1) == 2 * n - 4) & ~(below & above).any(1)
    around = np.full((len(p), n, n), -1, np.int8)
    for mask, (x, y, z) in ((below, (a, b, c)), (above, (a, c, b))):
        s, f = np.nonzero(mask & good[:, None])
        for u, v, w in ((x, y, z), (y, z, x), (z, x, y)):
            around[s, u[f], v[f]] = w[f]
    return around, good


def canonical(around: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(set, code, order) of every walk with the least code: ``order`` lists the vertices by their numbers.

    Walks start where the degrees of an edge's ends and of the vertex beside it
    are least, which the graph alone decides.
    """
    n = around.shape[1]
    degree = (around >= 0).sum(2)
    s, u, v = np.nonzero(around >= 0)
    key = (degree[s, u] * 32 + degree[s, v]) * 32 + degree[s, around[s, u, v]]
    least = np.full(len(around), 1 << 20)
    np.minimum.at(least, s, key)
    s, u, v = (x[key == least[s]] for x in (s, u, v))
    lane = np.arange(len(s))
    number, order, origin = np.full((len(s), n), -1), np.zeros((len(s), n), np.int64), np.zeros((len(s), n), np.int64)
    number[lane, u], number[lane, v] = 0, 1
    order[:, 0], order[:, 1] = u, v
    origin[lane, u], origin[lane, v] = v, u
    count, code = np.full(len(s), 2), np.zeros(len(s), np.uint64)
    for i in range(n):
        at = order[:, i]
        first = origin[lane, at]
        walk, live = first.copy(), lane
        while len(live):
            x, w = at[live], walk[live]
            new = number[live, w] < 0
            k = live[new]
            number[k, w[new]], order[k, count[k]], origin[k, w[new]] = count[k], w[new], x[new]
            count[k] += 1
            code[live] = code[live] * np.uint64(6364136223846793005) + (number[live, w] + 1).astype(np.uint64)
            walk[live] = around[s[live], x, w]
            live = live[walk[live] != first[live]]
        code = code * np.uint64(6364136223846793005) + np.uint64(77)
    best = np.full(len(around), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(best, s, code)
    tied = code == best[s]
    return s[tied], code[tied], order[tied]


@dataclass
class Template:
    """A structure's points, rotations, and the vertex orders for each code of its hull (of its outer shell for diamonds)."""

    kind: int
    points: np.ndarray
    rotations: np.ndarray
    moves: np.ndarray
    orders: dict[int, list[np.ndarray]] = field(default_factory=dict)

    @property
    def shell(self) -> slice:
        return slice(4, 16) if self.kind in (CUBIC_DIAMOND, HEX_DIAMOND) else slice(0, SIZES[self.kind])


def _splits(p: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """``around`` of the hull of ``p`` for each way to split its square faces, one of those that rotations map to each other."""
    n, faces = len(p), {}
    for t in itertools.combinations(range(n), 3):
        normal = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
        side = (p - p[t[0]]) @ normal
        if np.linalg.norm(normal) > 1e-9 and (side.max() < 1e-9 or side.min() > -1e-9):
            on = np.flatnonzero(np.abs(side) < 1e-9)
            out = normal * np.sign(p[t[0]] @ normal)
            e = p[on[0]] - p[on].mean(0)
            angle = np.arctan2((p[on] - p[on].mean(0)) @ np.cross(out / np.linalg.norm(out), e), (p[on] - p[on].mean(0)) @ e)
            faces[frozenset(on.tolist())] = on[np.argsort(angle)].tolist()
    squares = [f for f in faces.values() if len(f) == 4]
    pick = {frozenset(d): (k, bit) for k, f in enumerate(squares) for bit, d in enumerate(((f[0], f[2]), (f[1], f[3])))}
    masks = np.arange(1 << len(squares))
    least = masks.copy()
    for g in moves:
        image = np.zeros_like(masks)
        for (x, y), (k, bit) in ((tuple(d), v) for d, v in pick.items()):
            to, as_bit = pick[frozenset((int(g[x]), int(g[y])))]
            image |= np.where(((masks >> k) & 1) == bit, as_bit << to, 0)
        least = np.minimum(least, image)
    out = []
    for mask in np.unique(least):
        around = np.full((n, n), -1, np.int8)
        triangles = [f for f in faces.values() if len(f) == 3]
        for k, f in enumerate(squares):
            q = f if not (mask >> k) & 1 else f[1:] + f[:1]
            triangles += [[q[0], q[1], q[2]], [q[0], q[2], q[3]]]
        for x, y, z in triangles:
            around[x, y], around[y, z], around[z, x] = z, x, y
        out.append(around)
    return np.array(out)


@lru_cache
def template(kind: int) -> Template:
    p = _points(kind)
    t = Template(kind, p, *_rotations(p))
    if kind == GRAPHENE:
        return t
    shell = p[t.shell]
    moves = _rotations(shell)[1]
    own = {tuple(m[t.shell] - t.shell.start) for m in t.moves}
    for _, code, order in zip(*canonical(_splits(shell, moves)), strict=True):
        known = t.orders.setdefault(int(code), [])
        # of orders that the structure's own rotations map to each other one is kept
        for o in [m[order] for m in moves] if t.shell.start else [order]:
            if not any(any((np.array(g)[o] == k).all() for g in own) for k in known):
                known.append(o)
    return t


def superposed(points: np.ndarray, ideal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """RMSD, scale and quaternion (w, x, y, z) that map ``ideal`` to scaled ``points`` (B, n + 1, 3), the centre of both being the mean."""
    x = points - points.mean(1, keepdims=True)
    m = np.einsum("ni,bnj->bij", ideal, x)
    k = np.empty((len(x), 4, 4))
    k[:, 0, 0] = m.trace(axis1=1, axis2=2)
    k[:, 0, 1:] = k[:, 1:, 0] = np.stack([m[:, 1, 2] - m[:, 2, 1], m[:, 2, 0] - m[:, 0, 2], m[:, 0, 1] - m[:, 1, 0]], 1)
    k[:, 1:, 1:] = m + m.transpose(0, 2, 1) - k[:, 0, 0][:, None, None] * np.eye(3)
    value, vector = np.linalg.eigh(k)
    scale = value[:, 3] / np.maximum((x * x).sum((1, 2)), 1e-300)
    rest = (ideal * ideal).sum() - scale * value[:, 3]
    return np.sqrt(np.maximum(rest, 0) / len(ideal)), scale, vector[:, :, 3]


def matrices(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q.T
    return np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], 1).reshape(-1, 3, 3)


def quaternions(m: np.ndarray) -> np.ndarray:
    """(w, x, y, z) with w >= 0 of rotation matrices."""
    k = np.empty((len(m), 4, 4))
    t = m.trace(axis1=1, axis2=2)
    k[:, 0, 0] = t
    k[:, 0, 1:] = k[:, 1:, 0] = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], 1)
    k[:, 1:, 1:] = m + m.transpose(0, 2, 1) - t[:, None, None] * np.eye(3)
    q = np.linalg.eigh(k)[1][:, :, 3]
    return q * np.where(q[:, :1] < 0, -1, 1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quaternion products of (..., 4) arrays."""
    w, x, y, z = np.moveaxis(a, -1, 0)
    t, u, v, s = np.moveaxis(b, -1, 0)
    return np.stack([w * t - x * u - y * v - z * s, w * u + x * t + y * s - z * v, w * v - x * s + y * t + z * u, w * s + x * v - y * u + z * t], -1)


class Matches:
    """The best match so far of each of B particles."""

    def __init__(self, b: int):
        self.kind, self.rmsd, self.scale = np.zeros(b, int), np.full(b, np.inf), np.zeros(b)
        self.q, self.pick = np.zeros((b, 4)), np.full((b, 16), -1)

    def offer(self, t: Template, points: np.ndarray, who: np.ndarray, pick: np.ndarray) -> None:
        """``pick`` gives for each template point the neighbour; particles ``who``."""
        if len(who):
            own = np.take_along_axis(points[who], pick[:, :, None], 1)
            rmsd, scale, q = superposed(np.concatenate([np.zeros((len(who), 1, 3)), own], 1), np.concatenate([np.zeros((1, 3)), t.points]))
            better = rmsd < self.rmsd[who] - 1e-12
            at = who[better]
            self.kind[at], self.rmsd[at], self.scale[at], self.q[at] = t.kind, rmsd[better], scale[better], q[better]
            self.pick[at] = -1
            self.pick[at[:, None], np.arange(pick.shape[1])] = pick[better]


def _two_shells(points: np.ndarray, count: np.ndarray, inner: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Particles whose first ``inner`` neighbours have ``each`` nearest others of their own among the listed ones, and these neighbours, by inner one.

    The second shell is that of the first one's neighbours: by distance from the
    centre alone it would mix with the third.
    """
    who = np.flatnonzero(count >= inner * (each + 1))
    x = points[who]
    d = np.linalg.norm(x[:, None, inner:] - x[:, :inner, None], axis=3)
    listed = np.arange(inner, x.shape[1]) < count[who][:, None]
    d = np.where(listed[:, None], d, np.inf)
    outer = np.sort(np.argsort(d, axis=2, kind="stable")[:, :, :each], axis=2).reshape(len(who), inner * each) + inner
    apart = (np.diff(np.sort(outer, axis=1), axis=1) > 0).all(1)
    return who[apart], np.concatenate([np.broadcast_to(np.arange(inner), (len(who), inner)), outer], 1)[apart]


@lru_cache
def _sheet_orders() -> list[list[int]]:
    """The ways to pair graphene's template with two shells; of those that the template's rotations map to each other the first."""
    moves, known, out = template(GRAPHENE).moves, set(), []
    # template points 3 + 2 a and 4 + 2 a belong to a
    for inner in itertools.permutations(range(3)):
        for swap in itertools.product((0, 1), repeat=3):
            pick = [*inner, *[3 + 2 * inner[a] + (side ^ swap[a]) for a in range(3) for side in (0, 1)]]
            if tuple(pick) not in known:
                out.append(pick)
                known |= {tuple(np.array(pick)[g].tolist()) for g in moves}
    return out


def _sheets(m: Matches, points: np.ndarray, count: np.ndarray) -> None:
    t = template(GRAPHENE)
    who, near = _two_shells(points, count, 3, 2)
    for pick in _sheet_orders():
        m.offer(t, points, who, near[:, pick])


def match(points: np.ndarray, count: np.ndarray, structures: tuple[int, ...]) -> Matches:
    """The best structure of each row of neighbour vectors, nearest first, of which ``count`` are given."""
    m = Matches(len(points))
    jitter = np.random.default_rng(0).uniform(-1, 1, (32, 3))
    known: dict[tuple[int, int], list[Template]] = {}
    for t in map(template, structures):
        if t.kind != GRAPHENE:
            known.setdefault((t.shell.start, t.shell.stop), []).append(t)
    for (first, last), some in sorted(known.items()):
        if first:
            who, near = _two_shells(points, count, 4, 3)
        else:
            who = np.flatnonzero(count >= last)
            near = np.broadcast_to(np.arange(last), (len(who), last))
        shell = np.take_along_axis(points[who], near[:, first:, None], 1)
        # coplanar points are told apart by less than any noise
        shell = shell + 1e-6 * np.linalg.norm(points[who, :1], axis=2, keepdims=True) * jitter[: last - first]
        if not len(who):
            continue
        hulls = [facets(shell[lo : lo + HULLS]) for lo in range(0, len(who), HULLS)]
        around, good = (np.concatenate(x) for x in zip(*hulls, strict=True))
        who, near, around = who[good], near[good], around[good]
        if not len(who):
            continue
        s, code, order = canonical(around)
        s, at = np.unique(s, return_index=True)
        who, near, code, order = who[s], near[s], code[at], order[at]
        for t in some:
            for c in {int(x) for x in np.unique(code)} & t.orders.keys():
                of = np.flatnonzero(code == np.uint64(c))
                for o in t.orders[c]:
                    pick = np.zeros((len(of), last - first), int)
                    pick[:, o] = order[of] + first
                    fits = np.ones(len(of), bool)
                    if first:
                        # an inner point is the one that its three outer points share, in the template and here
                        ideal = np.linalg.norm(t.points[4:, None] - t.points[:4], axis=2).argmin(1)
                        inner = np.stack([(pick[:, ideal == k] - 4) // 3 for k in range(4)], 1)
                        fits = (inner == inner[:, :, :1]).all((1, 2))
                        pick = np.concatenate([inner[:, :, 0], pick], 1)
                    m.offer(t, points, who[of[fits]], np.take_along_axis(near[of[fits]], pick[fits], 1))
    if GRAPHENE in structures:
        _sheets(m, points, count)
    return m


def _least_turn(m: Matches) -> None:
    """Orientations and correspondences are those of the rotation with the least angle among equivalent ones."""
    for kind in np.unique(m.kind[m.kind > 0]):
        t, at = template(int(kind)), np.flatnonzero(m.kind == kind)
        every = product(m.q[at][:, None], quaternions(t.rotations)[None])
        best = np.abs(every[:, :, 0]).round(9).argmax(1)
        q = every[np.arange(len(at)), best]
        m.q[at] = q * np.where(q[:, :1] < 0, -1, 1)
        n = len(t.points)
        m.pick[at, :n] = np.take_along_axis(m.pick[at, :n], t.moves[best], 1)


def _order(m: Matches, own: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Ordering of binary alloys from the types of the matched neighbours; ``types`` by neighbour."""
    out = np.where(m.kind > 0, NO_ORDER, NO_ORDER)
    for kind in np.unique(m.kind[m.kind > 0]):
        t, at = template(int(kind)), np.flatnonzero(m.kind == kind)
        n = len(t.points)
        near = np.take_along_axis(types[at], m.pick[at, :n], 1)
        other = near != own[at][:, None]
        kinds = np.array([len({*row, c}) for row, c in zip(near.tolist(), own[at].tolist(), strict=True)])
        result = np.where(kinds == 1, PURE, NO_ORDER)
        two = kinds == 2
        if kind == FCC:
            result[two & other.all(1)] = L12_AU
            for axis in range(3):
                plane = np.abs(t.points[:, axis]) < 1e-9
                result[two & ~other[:, plane].any(1) & other[:, ~plane].all(1)] = L10
                result[two & other[:, plane].all(1) & ~other[:, ~plane].any(1)] = L12_CU
        elif kind == BCC:
            result[two & other[:, :8].all(1) & ~other[:, 8:].any(1)] = B2
        elif kind in (CUBIC_DIAMOND, HEX_DIAMOND):
            result[two & other[:, :4].all(1) & ~other[:, 4:].any(1)] = SIC
        elif kind == GRAPHENE:
            result[two & other[:, :3].all(1) & ~other[:, 3:].any(1)] = BN
        out[at] = result
    return out


def template_matching(df: DataFrame, cell: Cell, structures: tuple[int, ...] = DEFAULT, rmsd_cutoff: float = 0.1, type_col: str | None = None) -> DataFrame:
    """``df`` with the structure whose template each particle's nearest neighbours match best.

    The neighbours are the nearest ones; for diamonds and graphene those of the
    first shell and their own nearest ones.  structure_type is OTHER where no graph matches or the RMSD exceeds
    ``rmsd_cutoff`` (0: no cutoff); rmsd is in units of the mean neighbour
    distance and given for every match.  interatomic_distance is that of the
    scaled template, orientation the quaternion that turns the template to the
    particle's surroundings, the one of least angle among equivalent ones, and
    deformation the row-wise gradient that maps the scaled template to the
    neighbours best.  With ``type_col`` ordering_type tells how two types are
    arranged.  template_neighbors lists the neighbours in the template's order.
    """
    structures = tuple(dict.fromkeys(structures))
    k = max(LISTED[s] for s in structures)
    kind = F.col(type_col).cast("long") if type_col else F.lit(0).cast("long")

    def then(b: pa.RecordBatch) -> pa.RecordBatch:
        parts = [_matched(b.slice(at, CHUNK), k, structures) for at in range(0, b.num_rows, CHUNK)]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]

    # matched where the lists are made
    rows = df.select(F.col("frame").cast("int").alias("frame"), "idx", "position", kind.alias("kind"))
    found = nearest_lists(rows, cell, k, ("kind",), ("kind",), then, SCHEMA)
    fits = F.col("structure") > 0
    kept = fits & (F.col("rmsd") <= rmsd_cutoff) if rmsd_cutoff else fits
    q = F.when(kept, F.struct(F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("qz").alias("z"), F.col("qw").alias("w")))
    out = found.select(
        "frame", "idx", F.when(kept, F.col("structure")).otherwise(OTHER).alias("structure_type"), F.when(fits, F.col("rmsd")).alias("rmsd"), F.when(kept, F.col("interatomic_distance")).alias("interatomic_distance"), q.alias("orientation"),
        F.when(kept, F.col("deformation")).alias("deformation"), F.when(kept, F.col("ordering_type")).otherwise(NO_ORDER).alias("ordering_type"), F.when(kept, F.col("neighbors")).alias("template_neighbors"),
    )
    named = [c for c in out.columns if c not in ("frame", "idx")]
    return df.drop(*named).join(out, ["frame", "idx"], "left").withColumns({"structure_type": F.coalesce("structure_type", F.lit(OTHER)), "ordering_type": F.coalesce("ordering_type", F.lit(NO_ORDER))})


def _matched(b: pa.RecordBatch, k: int, structures: tuple[int, ...]) -> pa.RecordBatch:
    lists = b.column("near")
    ends = lists.offsets.to_numpy()
    flat = lists.flatten()
    count = np.diff(ends)
    slot = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], count)
    row = np.repeat(np.arange(b.num_rows), count)
    points, j, types = np.zeros((b.num_rows, k, 3)), np.full((b.num_rows, k), -1), np.full((b.num_rows, k), -1)
    for d, c in enumerate(("dx", "dy", "dz")):
        points[row, slot, d] = flat.field(c).to_numpy()
    j[row, slot], types[row, slot] = flat.field("j").to_numpy(), flat.field("kind").fill_null(-1).to_numpy()
    m = match(points, count, structures)
    _least_turn(m)
    ordering = _order(m, b.column("own_kind").fill_null(-1).to_numpy(), types)
    rmsd = np.where(m.kind > 0, m.rmsd, 0.0)
    deformation, neighbors, distance = [None] * b.num_rows, [None] * b.num_rows, np.zeros(b.num_rows)
    for kind in np.unique(m.kind[m.kind > 0]):
        t, at = template(int(kind)), np.flatnonzero(m.kind == kind)
        n = len(t.points)
        v = np.take_along_axis(points[at], m.pick[at, :n, None], 1) * m.scale[at][:, None, None]
        gradient = np.einsum("bni,nj->bij", v, t.points) @ np.linalg.pinv(t.points.T @ t.points)
        # the template has a mean distance of one; that of its first shell is reported
        distance[at] = np.linalg.norm(t.points[0]) / m.scale[at]
        for a, g, p in zip(at, gradient.reshape(-1, 9).tolist(), j[at[:, None], m.pick[at, :n]].tolist(), strict=True):
            deformation[a], neighbors[a] = g, p
    arrays = [b.column("frame"), b.column("idx"), pa.array(m.kind.astype(np.int32)), pa.array(rmsd), pa.array(distance), *(pa.array(m.q[:, c]) for c in (1, 2, 3, 0)), pa.array(deformation, pa.list_(pa.float64())), pa.array(ordering.astype(np.int32)), pa.array(neighbors, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])


def template_order(matched: DataFrame) -> DataFrame:
    """(frame, i, place, j, tx, ty, tz): the neighbours of matched particles in their template's order, and the template's vectors turned to them."""
    points = {s: template(s).points for s in SIZES}
    table = F.create_map(*[x for s, p in points.items() for x in (F.lit(s), F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("xyz", row, strict=True)]) for row in p]))])
    o = F.col("orientation")
    rows = matched.filter(F.col("structure_type") > 0).select("frame", F.col("idx").alias("i"), "orientation", table[F.col("structure_type")].alias("points"), F.posexplode("template_neighbors").alias("place", "j"))
    p = F.col("points")[F.col("place")]
    # v + 2 w (u x v) + 2 u x (u x v)
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    u, v = [o["x"], o["y"], o["z"]], [p["x"], p["y"], p["z"]]
    once = cross(u, v)
    twice = cross(u, once)
    return rows.select("frame", "i", "place", "j", *[(v[d] + 2 * o["w"] * once[d] + 2 * twice[d]).alias(f"t{c}") for d, c in enumerate("xyz")])


def rmsd_histogram(matched: DataFrame, bins: int = 100) -> DataFrame:
    """(frame, bin, rmsd, count) of matched particles over 0 to 1.01 times each frame's largest RMSD."""
    rows = matched.filter((F.col("structure_type") > 0) & F.col("rmsd").isNotNull()).select("frame", "rmsd")
    top = rows.groupBy("frame").agg((F.max("rmsd") * 1.01).alias("top"))
    at = rows.join(top, "frame").groupBy("frame", F.when(F.col("top") > 0, F.least(F.lit(bins - 1), (F.col("rmsd") / F.col("top") * bins).cast("int"))).otherwise(0).alias("bin")).agg(F.count("*").alias("count"))
    every = top.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(at, ["frame", "bin"], "left").select("frame", "bin", ((F.col("bin") + 0.5) * F.col("top") / bins).alias("rmsd"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
