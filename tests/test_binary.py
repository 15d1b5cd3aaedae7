"""Binary trajectories against files that are written here, byte by byte."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from mesolite.sources import binary as B


def dump_frame(step, rows, order="<", named=None, tilt=None, time=None, chunks=2):
    out = b""
    if named is not None:
        magic = b"DUMPCUSTOM"
        out += struct.pack(order + "q", -len(magic)) + magic + struct.pack(order + "ii", 1, 2)
    out += struct.pack(order + "qqi6i6d", step, len(rows), int(tilt is not None), 0, 0, 0, 0, 1, 1, 0, 10, 0, 20, -5, 5)
    if tilt is not None:
        out += struct.pack(order + "3d", *tilt)
    out += struct.pack(order + "i", rows.shape[1])
    if named is not None:
        out += struct.pack(order + "i", 4) + b"real" + struct.pack("b", time is not None) + (struct.pack(order + "d", time) if time is not None else b"")
        out += struct.pack(order + "i", len(named)) + named.encode()
    out += struct.pack(order + "i", chunks)
    for part in np.array_split(rows, chunks):
        out += struct.pack(order + "i", part.size) + part.astype(order + "f8").tobytes()
    return out


@pytest.mark.parametrize(("order", "named", "tilt", "time"), [("<", None, None, None), (">", "id type x", None, 2.5), ("<", "id type x", (0.5, 0.0, 1.0), None)])
def test_binary_dump(spark, tmp_path, order, named, tilt, time):
    rng = np.random.default_rng(1)
    frames = [rng.normal(size=(n, 3)) for n in (5, 1, 7)]
    whole = [dump_frame(10 * k, f, order, named, tilt, time) for k, f in enumerate(frames)]
    (tmp_path / "a.bin").write_bytes(b"".join(whole) + whole[0][:-9])  # the last frame is cut off
    (tmp_path / "b.bin").write_bytes(whole[2])
    df = B.binary_dump(spark, str(tmp_path), 300)
    assert df.rdd.getNumPartitions() == 4
    got = df.collect()
    want = [("a.bin", k, 10 * k, i, row) for k, f in enumerate(frames) for i, row in enumerate(f.tolist())] + [("b.bin", 0, 20, i, row) for i, row in enumerate(frames[2].tolist())]
    assert sorted((r.file.rsplit("/", 1)[1], r.frame, r.timestep, r.idx, r["values"]) for r in got) == sorted(want)
    assert {(tuple(r.columns) if r.columns else None, tuple(r.box), tuple(r.tilt), tuple(r.boundary), r.time) for r in got} == {(tuple(named.split()) if named else None, (0, 10, 0, 20, -5, 5), tilt or (0, 0, 0), (0, 0, 0, 0, 1, 1), time)}


def test_what_is_no_dump_or_not_there(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"\xff" * 4000)
    with pytest.raises(Exception, match="no header"):
        B.binary_dump(spark, str(tmp_path / "x")).collect()
    with pytest.raises(Exception, match="FileNotFound"):
        B.binary_dump(spark, str(tmp_path / "none")).collect()
    (tmp_path / "empty").write_bytes(b"")
    assert B.binary_dump(spark, str(tmp_path / "empty")).count() == 0


def gsd_file(frames, version):
    """``frames``: a dict of arrays for each."""
    names, entries, body, at = [], [], b"", 256
    kinds = {v: k for k, v in B._TYPES.items()}
    for f, chunks in enumerate(frames):
        for name, a in chunks.items():
            if name not in names:
                names.append(name)
            a = np.asarray(a)
            n, m = (a.shape[0], a.shape[1] if a.ndim > 1 else 1)
            kind = a.dtype.str if a.dtype.itemsize > 1 else a.dtype.str[1:]
            entries.append((f, n, at, m, names.index(name), kinds[kind], 0))
            body += a.tobytes()
            at += a.nbytes
    table = b"".join(x.encode() + b"\0" for x in names) if version >= 2 else b"".join(x.encode().ljust(64, b"\0") for x in names)
    table = table.ljust(-(-len(table) // 64) * 64 + 64, b"\0")
    index = np.array([*entries, (0,) * 7], B._ENTRY).tobytes()
    head = struct.pack("<5Q2I", B.MAGIC, at, len(entries) + 1, at + len(index), len(table) // 64, 0x10004, version << 16) + b"hoomd".ljust(64, b"\0") + b"hoomd".ljust(64, b"\0") + b"\0" * 80
    return head + body + index + table


@pytest.mark.parametrize("version", [1, 2])
def test_gsd(spark, tmp_path, version):
    p = np.arange(9, dtype="<f4").reshape(3, 3)
    types = np.array([[65, 0], [66, 98]], "i1")
    frames = [
        {"configuration/step": np.array([7], "<u8"), "configuration/box": np.array([4, 5, 6, 0, 0.5, 0], "<f4"), "particles/N": np.array([3], "<u4"), "particles/position": p, "particles/types": types, "particles/typeid": np.array([0, 1, 0], "<u4"), "particles/mass": np.array([1, 2, 3], "<f4")},
        {"configuration/step": np.array([9], "<u8"), "particles/position": p + 1},
        {"configuration/step": np.array([11], "<u8"), "particles/N": np.array([2], "<u4"), "particles/position": p[:2]},
    ]
    (tmp_path / "t.gsd").write_bytes(gsd_file(frames, version))
    got = sorted(B.gsd(spark, str(tmp_path / "t.gsd")).collect(), key=lambda r: (r.frame, r.idx))
    assert [(r.frame, r.step, r.idx, r.type, tuple(r.position), r.mass, r.diameter) for r in got] == [
        *[(0, 7, k, ["A", "Bb", "A"][k], tuple(p[k]), k + 1.0, 1.0) for k in range(3)],
        *[(1, 9, k, ["A", "Bb", "A"][k], tuple(p[k] + 1), k + 1.0, 1.0) for k in range(3)],
        *[(2, 11, k, "A", tuple(p[k]), 1.0, 1.0) for k in range(2)],
    ]
    assert {(tuple(r.box), tuple(r.orientation)) for r in got} == {((4, 5, 6, 0, 0.5, 0), (1, 0, 0, 0))}
