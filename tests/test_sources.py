from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.operators import trajectory
from mesolite.plans.tables import TRACK, events
from mesolite.sources import data_file, dump, sinks, text
from mesolite.streaming import live
from tests.oracle import SF_DIR

FRAME = "ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n3\nITEM: BOX BOUNDS pp ff pp\n0 10\n-5 5\n0 20\nITEM: ATOMS id type xs ys zs c_e\n3 1 0.5 0.5 0.25 1.5\n1 2 0 0 0 -2\n2 1 1 1 1 1e-204\n"


def test_dump_frames(spark, tmp_path):
    for k, steps in ((9, (0, 100)), (10, (0, 50))):
        (tmp_path / f"run{k}.dump").write_text("".join(FRAME.format(t=t) for t in steps))
    (tmp_path / "run11.dump").write_text(FRAME.format(t=7) + FRAME.format(t=8)[:-40])
    rows, cells = dump.read(spark, str(tmp_path), ("c_e",), sort_by_id=True)
    got = [(r.frame, r.timestep, r.ax, r.oy, r.pbc_x, r.pbc_y) for r in cells.orderBy("frame").collect()]
    assert got == [(k, t, 10.0, -5.0, True, False) for k, t in enumerate((0, 100, 0, 50, 7))]
    first = rows.filter("frame = 0").orderBy("idx").collect()
    assert [(r.particle_identifier, r.particle_type, tuple(r.position), r.c_e) for r in first] == [(1, 2, (0.0, -5.0, 0.0), -2.0), (2, 1, (10.0, 5.0, 20.0), 1e-204), (3, 1, (5.0, 0.0, 5.0), 1.5)]
    assert rows.count() == 15


def test_dump_of_a_tilted_box_round_trip(spark, tmp_path):
    cell = Cell(((10.0, 2.0, -1.0), (0.0, 8.0, 0.5), (0.0, 0.0, 6.0)), (1.0, 2.0, 3.0))
    rows = spark.createDataFrame([(f, k, k + 10, k % 3, (0.1 * k, 1.0 / (k + 1), f * 1.0), k * 2.5) for f in (0, 1) for k in range(20)], "frame int, idx long, particle_identifier long, particle_type int, position struct<x: double, y: double, z: double>, charge double")
    sinks.write_dump(rows, str(tmp_path / "out"), cell, ("charge",))
    got, cells = dump.read(spark, str(tmp_path / "out" / "*"), ("charge",))
    c = cells.first()
    assert [c.ax, c.bx, c.by, c.cx, c.cy, c.cz, c.ox, c.oy, c.oz] == pytest.approx([10, 2, 8, -1, 0.5, 6, 1, 2, 3])
    key = lambda d: sorted((r.frame, r.idx, r.particle_identifier, r.particle_type, tuple(r.position), r.charge) for r in d.collect())
    assert key(got) == key(rows)


def test_dump_needs_a_triangular_cell(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_dump(spark.createDataFrame([], "frame int"), str(tmp_path / "x"), Cell(((1.0, 0.0, 0.0), (0.5, 1.0, 0.0), (0.0, 0.0, 1.0))))


def test_xyz(spark, tmp_path):
    body = '2\nLattice="4 0 0 0 5 0 0 0 6" Properties=id:I:1:species:S:1:pos:R:3 energy=-1.5 note="a b"\n1 Si 0.5 1 2\n2 H 1 2 3\n'
    (tmp_path / "a.xyz").write_text(body + "1\nplain\nO 7 8 9\n3\ncut\nO 1 1 1\n")
    rows, frames = text.xyz(spark, str(tmp_path / "a.xyz"))
    assert [(r.frame, r.idx, r.species, tuple(r.position)) for r in rows.orderBy("frame", "idx").collect()] == [(0, 0, "Si", (0.5, 1.0, 2.0)), (0, 1, "H", (1.0, 2.0, 3.0)), (1, 0, "O", (7.0, 8.0, 9.0))]
    f = frames.orderBy("frame").collect()
    assert f[0].lattice == [4.0, 0, 0, 0, 5.0, 0, 0, 0, 6.0] and f[0].attributes == {"energy": "-1.5", "note": "a b"} and f[1].lattice is None


def test_xyz_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, k, k % 2, (k / 3, -k * 1.0, 1e-9 * k)) for k in range(5)], "frame int, idx long, particle_type int, position struct<x: double, y: double, z: double>")
    sinks.write_xyz(rows, str(tmp_path / "o"), Cell.box(3, 4, 5), {0: "big one", 1: "H"})
    got, _ = text.xyz(spark, str(tmp_path / "o" / "*"))
    assert [(r.species, tuple(r.position)) for r in got.orderBy("idx").collect()] == [("H" if k % 2 else "big_one", (k / 3, -k * 1.0, 1e-9 * k)) for k in range(5)]


def test_poscar(spark, tmp_path):
    (tmp_path / "p").write_text("c\n2.0\n1 0 0\n0 2 0\n1 0 3\nCo Ni\n1 2\nSelective\nDirect\n0.5 0.5 0.5 T T T\n0 0 0\n0 0 1\n")
    (tmp_path / "q").write_text("Al\n1.5\n1 0 0\n0 1 0\n0 0 1\n1\nCartesian\n1 2 3\n")
    got = [(r.particle_type, r.species, tuple(r.position)) for r in text.poscar(spark, str(tmp_path / "[pq]")).orderBy("file", "idx").collect()]
    assert got == [(1, "Co", (2.0, 2.0, 3.0)), (2, "Ni", (0.0, 0.0, 0.0)), (2, "Ni", (2.0, 0.0, 6.0)), (1, "Al", (1.5, 3.0, 4.5))]


def test_fixed_columns_and_meshes(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("HEADER\nATOM      7  CA  GLY A  12       1.500  -2.250  30.125  1.00  0.00           C  \nEND\n")
    r = text.pdb(spark, str(tmp_path / "a.pdb")).first()
    assert (r.particle_identifier, r.name, r.residue, r.chain, r.residue_number, tuple(r.position), r.element) == (7, "CA", "GLY", "A", 12, (1.5, -2.25, 30.125), "C")
    (tmp_path / "a.gro").write_text("t\n 1\n    1WATER  OW1    1   0.126   1.624   1.679\n 1 1 1\n")
    r = text.gro(spark, str(tmp_path / "a.gro")).first()
    assert (r.residue, r.name, [round(x, 3) for x in r.position]) == ("WATER", "OW1", [1.26, 16.24, 16.79])
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 3\n")
    v, f = text.obj(spark, str(tmp_path / "a.obj"))
    assert v.count() == 3 and f.first().corners == [1, 2, 3]
    (tmp_path / "a.stl").write_text("solid\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1e0 0\nendloop\nendfacet\nendsolid\n")
    assert [tuple(r.position) for r in text.stl(spark, str(tmp_path / "a.stl")).orderBy("corner").collect()] == [(0, 0, 0), (1, 0, 0), (0, 1, 0)]


DATA = """chain

3 atoms
2 bonds
1 angles
2 atom types
1 bond types
1 angle types

0 10 xlo xhi
-1 9.5 ylo yhi
0 20 zlo zhi
1.5 0 -2 xy xz yz

Masses

1 12.011  # C
2 1.008

Pair Coeffs # lj/cut

1 0.1 3.4

Atoms # full

2 7 2 0.5 1 2 3 0 1 -1
1 7 1 -0.5 4 5 6 0 0 0

3 8 2 0 7 8 9 1 0 0

Velocities

3 0.1 0.2 0.3
1 -1 -2 -3

Bonds

1 1 1 2
2 1 1 3

Angles

1 1 2 1 3
"""


def test_data_file(spark, tmp_path):
    (tmp_path / "a.data").write_text(DATA)
    got = data_file.read(spark, str(tmp_path / "a.data"))
    h = got["header"].first()
    assert (h.atoms, h.bonds, h.angles, h.dihedrals, h.atom_types, h.bond_types) == (3, 2, 1, 0, 2, 1)
    assert (h.xlo, h.xhi, h.ylo, h.yhi, h.zlo, h.zhi, h.xy, h.xz, h.yz) == (0, 10, -1, 9.5, 0, 20, 1.5, 0, -2)
    rows = data_file.particles(got).orderBy("particle_identifier").collect()
    assert [(r.particle_identifier, r.particle_type, r.molecule_identifier, r.charge, tuple(r.position), tuple(r.image), r.velocity and tuple(r.velocity), r.mass) for r in rows] == [
        (1, 1, 7, -0.5, (4, 5, 6), (0, 0, 0), (-1, -2, -3), 12.011),
        (2, 2, 7, 0.5, (1, 2, 3), (0, 1, -1), None, 1.008),
        (3, 2, 8, 0.0, (7, 8, 9), (1, 0, 0), (0.1, 0.2, 0.3), 1.008),
    ]
    assert [(r.id, r.type, r.members) for r in got["bonds"].orderBy("id").collect()] == [(1, 1, [1, 2]), (2, 1, [1, 3])]
    assert got["angles"].first().members == [2, 1, 3] and got["impropers"].count() == 0


def test_data_file_styles(spark, tmp_path):
    head = "t\n\n1 atoms\n2 atom types\n\n0 1 xlo xhi\n0 1 ylo yhi\n0 1 zlo zhi\n\nAtoms"
    for name, rest in {"a": "\n\n5 2 1 2 3\n", "c": "\n\n5 2 -0.25 1 2 3\n", "b": "\n\n5 9 2 1 2 3\n", "s": " # sphere\n\n5 2 3.0 1.1 1 2 3\n"}.items():
        (tmp_path / name).write_text(head + rest)
    read = lambda n: data_file.read(spark, str(tmp_path / n))["atoms"].first()
    assert all((read(n).particle_type, tuple(read(n).position), read(n).image) == (2, (1, 2, 3), None) for n in "acbs")
    assert (read("c").charge, read("b").molecule_identifier, read("s").radius) == (-0.25, 9, 1.5)
    (tmp_path / "w").write_text(head + "\n\n5 3 1 2 3\n")
    with pytest.raises(Exception, match="out of range"):
        read("w")
    with pytest.raises(ValueError):
        data_file.read(spark, str(tmp_path / "a"), "no such style")


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_dump_stream(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"s{k}.dump").write_text(FRAME.format(t=k))
    got = drain(live.step_counts(live.dump_stream(spark, str(tmp_path))), "steps", "complete").orderBy("timestep").collect()
    assert [(r.timestep, r.n, r.mean_x) for r in got] == [(k, 3, 5.0) for k in range(3)]


def test_unwrapped_stream_is_the_batch_result(spark, tmp_path):
    rows = events(spark, SF_DIR).filter("particle_identifier < 20")
    rows.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    got = drain(live.unwrap_stream(stream, TRACK), "unwrapped", "append").select("particle_identifier", "frame", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    want = trajectory.unwrap(rows, TRACK).select("particle_identifier", "frame", F.round("position.x", 6).alias("x"), F.round("position.y", 6).alias("y"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_frames_of_many_atoms_whose_names_begin_with_i(spark, tmp_path):
    body = "\n".join(f"{k} 1 0.5 0.5 0.5 In" for k in range(20_000))
    (tmp_path / "a.dump").write_text(f"ITEM: TIMESTEP\n7\nITEM: NUMBER OF ATOMS\n20000\nITEM: BOX BOUNDS pp pp pp\n0 1\n0 1\n0 1\nITEM: ATOMS id type xs ys zs element\n{body}\n" + FRAME.format(t=8))
    got = dump.frames(spark, str(tmp_path / "a.dump")).select("timestep", F.size("lines").alias("n")).orderBy("timestep").collect()
    assert [tuple(r) for r in got] == [(7, 20_000), (8, 3)]


def test_frames_with_either_line_end(spark, tmp_path):
    (tmp_path / "a.dump").write_bytes((FRAME.format(t=8) + FRAME.format(t=9)).replace("\n", "\r\n").encode())
    got = dump.frames(spark, str(tmp_path / "a.dump")).select("timestep", F.size("lines").alias("n"), "bounds").orderBy("timestep").collect()
    assert [tuple(r) for r in got] == [(t, 3, [0.0, 10.0, -5.0, 5.0, 0.0, 20.0]) for t in (8, 9)]


def some_atoms(spark):
    rows = [(0, k, 10 + k, 1 + k % 2, (k / 3, 1.0 + k, 1e-9 * k)) for k in range(5)]
    return spark.createDataFrame(rows, "frame int, idx long, particle_identifier long, particle_type int, position struct<x: double, y: double, z: double>")


def test_data_round_trip(spark, tmp_path):
    rows = some_atoms(spark)
    bonds = spark.createDataFrame([(0, 0, 0, 3, 2), (0, 1, 4, 1, 1)], "frame int, bond_idx long, a long, b long, bond_type int")
    for name, some in (("plain", None), ("bonded", bonds)):
        sinks.write_data(rows, str(tmp_path / name), Cell.box(3, 14, 5, origin=(-1.0, 0.0, 0.0)), some)
        got = data_file.read(spark, str(tmp_path / name / "frame=0" / "*"))
        head = got["header"].first()
        assert (head.atoms, head.atom_types, head.xlo, head.xhi, head.bonds) == (5, 2, -1.0, 2.0, 2 * bool(some))
        atoms = data_file.particles(got).orderBy("particle_identifier").collect()
        assert [(r.particle_identifier, r.particle_type, tuple(r.position)) for r in atoms] == [(10 + k, 1 + k % 2, (k / 3, 1.0 + k, 1e-9 * k)) for k in range(5)]
    assert got["bonds"].count() == 2


@pytest.mark.parametrize("reduced", [False, True])
def test_poscar_round_trip(spark, tmp_path, reduced):
    sinks.write_poscar(some_atoms(spark), str(tmp_path / "o"), Cell.box(3, 14, 5), {2: "Si", 1: "H"}, reduced)
    got = text.poscar(spark, str(tmp_path / "o" / "frame=0" / "*")).orderBy("idx").collect()
    want = [(("Si", "H")[k % 2 == 0], (k / 3, 1.0 + k, 1e-9 * k)) for k in (1, 3, 0, 2, 4)]
    assert [r.species for r in got] == [s for s, _ in want]
    assert all(tuple(r.position) == pytest.approx(p, abs=1e-12) for r, (_, p) in zip(got, want, strict=True))


def test_attribute_table(spark, tmp_path):
    sinks.write_attributes(spark.createDataFrame([(2, 1.5, "two words"), (0, 2.5, "one")], "frame int, energy double, n string"), str(tmp_path / "o"), ("frame", "energy", "n"))
    got = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert sorted(got) == sorted(['# "frame" "energy" "n"', "0 2.5 one", '2 1.5 "two words"'])
    with pytest.raises(Exception, match="'n' is missing in frame 2"):  # a missing value is no 0
        sinks.write_attributes(spark.createDataFrame([(2, 1.5, None), (0, 2.5, 7)], "frame int, energy double, n int"), str(tmp_path / "p"), ("frame", "energy", "n"))


def test_local_dump(spark, tmp_path):
    one = "ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ENTRIES\n2\nITEM: BOX BOUNDS pp pp pp\n0 1\n0 1\n0 1\nITEM: ENTRIES index c_d[1]\n1 0.5\n2 1e-3\n"
    (tmp_path / "a").write_text(one.format(t=0) + one.format(t=50).replace("\n", "\r\n") + one.format(t=60)[:-7])
    rows, frames = text.dump_local(spark, str(tmp_path / "a"))
    assert sorted((r.timestep, r.no, r["values"]["c_d[1]"]) for r in rows.collect()) == [(0, 0, 0.5), (0, 1, 1e-3), (50, 0, 0.5), (50, 1, 1e-3)]
    assert {r.timestep for r in frames.collect()} == {0, 50}


def test_cfg(spark, tmp_path):
    head = "Number of particles = 2\nA = 2.0 Angstrom\n" + "".join(f"H0({a},{b}) = {3.0 if a == b else 0.5 * (a > b)} A\n" for a in (1, 2, 3) for b in (1, 2, 3))
    (tmp_path / "e").write_text(head + ".NO_VELOCITY.\nentry_count = 4\nauxiliary[0] = pe [eV]\n28.0\nSi\n0.5 0 0.5 -1.5\n1.0\nH\n0 1 0 2\n")
    (tmp_path / "p").write_text(head + "28.0 Si 0.5 0 0.5 0 0 0\n1.0 H 0 1 0 1 2 3\n")
    for name, rest in (("e", [[-1.5], [2.0]]), ("p", [[0.0] * 3, [1.0, 2.0, 3.0]])):
        atoms, header = text.cfg(spark, str(tmp_path / name))
        got = atoms.orderBy("idx").collect()
        assert [(r.idx, r.mass, r.species, tuple(r.position), r.rest) for r in got] == [(0, 28.0, "Si", (3.5, 0.5, 3.0), rest[0]), (1, 1.0, "H", (1.0, 6.0, 0.0), rest[1])]
        assert header.first().n == 2 and header.first().h == [3.0, 0, 0, 0.5, 3.0, 0, 0.5, 0.5, 3.0]


def test_cube(spark, tmp_path):
    (tmp_path / "a").write_text("c\nc\n 1 0 0 0\n 2 1 0 0\n 1 0 1 0\n 3 0 0 1\n 14 14.0 1.0 0 0\n 0 1 2\n 3\n 4 5\n")
    atoms, grid = text.cube(spark, str(tmp_path / "a"))
    r = atoms.first()
    assert (r.atomic_number, r.position.x) == (14, pytest.approx(text.BOHR))
    assert sorted((r.x, r.y, r.z, r.value) for r in grid.collect()) == [(a, 0, c, 3.0 * a + c) for a in (0, 1) for c in range(3)]


def test_cube_with_a_table_of_fields(spark, tmp_path):
    (tmp_path / "a").write_text("c\nc\n -1 0.5 0 0\n 2 1 0 0\n -1 0 1 0\n 1 0 0 2\n 14 14.0 1.0 0 0\n 2 7\n 9 0.5 0.25\n 0.125 2\n")
    atoms, grid = text.cube(spark, str(tmp_path / "a"))
    assert (atoms.count(), atoms.first().position.x) == (1, 1.0)  # one negative number of voxels: Angstrom
    assert sorted((r.x, r.y, r.z, r.component, r.name, r.value) for r in grid.collect()) == [(0, 0, 0, 0, "MO7", 0.5), (0, 0, 0, 1, "MO9", 0.25), (1, 0, 0, 0, "MO7", 0.125), (1, 0, 0, 1, "MO9", 2.0)]
    cell = text.cube_cells(spark, str(tmp_path / "a")).first()
    assert (cell.shape, cell.origin, cell.vectors) == ([2, 1, 1], [0.5, 0, 0], [2, 0, 0, 0, 1, 0, 0, 0, 2])


def test_vtk_vectors(spark, tmp_path):
    rows = [(0, x, 0, 0, (1.0 * x, 2.0, None), (x, 7), x) for x in range(2)]
    grid = spark.createDataFrame(rows, "frame int, vx int, vy int, vz int, `the force` struct<x: double, y: double, z: double>, pair struct<a: int, b: int>, n int")
    sinks.write_vtk_grid(grid, str(tmp_path / "o"), Cell.box(2, 1, 1), (2, 1, 1), ("the force", "pair", "n"))
    got = next((tmp_path / "o" / "frame=0").glob("*.txt")).read_text().splitlines()[8:]
    assert got == ["", "VECTORS theforce double", "0.0000000000000000 2.0000000000000000 NaN", "1.0000000000000000 2.0000000000000000 NaN", "", "SCALARS pair int 2", "LOOKUP_TABLE default", "0 7", "1 7", "", "SCALARS n int 1", "LOOKUP_TABLE default", "0", "1"]


def test_xsf(spark, tmp_path):
    (tmp_path / "m").write_text("# animation\nANIMSTEPS 2\nATOMS 1\nSi 0 1 2\n 8 1 1 1 0.5 0 0\nATOMS 2\nSi 3 3 3\n")
    atoms, cells, grid = text.xsf(spark, str(tmp_path / "m"))
    got = [(r.frame, r.idx, r.species, tuple(r.position), r.force and tuple(r.force)) for r in atoms.orderBy("frame", "idx").collect()]
    assert got == [(0, 0, "Si", (0, 1, 2), None), (0, 1, "8", (1, 1, 1), (0.5, 0, 0)), (1, 0, "Si", (3, 3, 3), None)]
    assert cells.count() == grid.count() == 0
    body = "\n".join(" ".join(str(x + 2 * y + 6 * z) for x in range(2)) for z in range(2) for y in range(3))
    (tmp_path / "c").write_text(f"CRYSTAL\nPRIMVEC\n1 0 0\n0 2 0\n0 0 3\n\nPRIMCOORD\n 1 1\n14 0.5 0.5 0.5\nBEGIN_BLOCK_DATAGRID_3D\n any\nBEGIN_DATAGRID_3D_rho\n2 3 2\n0 0 0\n1 0 0\n0 2 0\n0 0 3\n{body}\nEND_DATAGRID_3D\nEND_BLOCK_DATAGRID_3D\n")
    atoms, cells, grid = text.xsf(spark, str(tmp_path / "c"))
    assert [(r.idx, r.species, tuple(r.position)) for r in atoms.collect()] == [(0, "14", (0.5, 0.5, 0.5))]
    assert cells.first().vectors == [1, 0, 0, 0, 2, 0, 0, 0, 3]
    assert sorted((r.name, r.z, r.y, r.x, r.value) for r in grid.collect()) == [("rho", z, y, x, float(x + 2 * y + 6 * z)) for z in range(2) for y in range(3) for x in range(2)]


def test_vtk_grid(spark, tmp_path):
    rows = [(f, x, y, z, x + 0.5 * y + f, 10 * z + y if x or y else None) for f in (0, 1) for x in range(2) for y in range(3) for z in range(2)]
    grid = spark.createDataFrame(rows, "frame int, vx int, vy int, vz int, a double, `b c` long").repartition(5)
    sinks.write_vtk_grid(grid, str(tmp_path / "o"), Cell.box(2, 6, 1, origin=(1.0, 0.0, 0.0)), (2, 3, 2), ("a", "b c"))
    for f in (0, 1):
        file = next((tmp_path / "o" / f"frame={f}").glob("*.txt"))
        got = file.read_text().splitlines()
        assert got[:8] == ["# vtk DataFile Version 3.0", "Voxel grid", "ASCII", "DATASET STRUCTURED_POINTS", "DIMENSIONS 2 3 2", "ORIGIN 1.0 0.0 0.0", "SPACING 1.0 2.0 0.5", "POINT_DATA 12"]
        assert got[8:11] == ["", "SCALARS a double 1", "LOOKUP_TABLE default"] and got[23:26] == ["", "SCALARS bc long 1", "LOOKUP_TABLE default"]
        order = [(x, y, z) for z in range(2) for y in range(3) for x in range(2)]
        assert [float(v) for v in got[11:23]] == [x + 0.5 * y + f for x, y, z in order]
        assert [int(v) for v in got[26:]] == [10 * z + y if x or y else 0 for x, y, z in order]
