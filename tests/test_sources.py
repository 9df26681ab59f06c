import io
import pickle
import tarfile

import pytest
from pyspark.sql import functions as F

from poregrid.sinks import reports
from poregrid.sources import text, traces

HEADER = "Snapshot, Tunnel cluster, Tunnel, Throughput, Cost, Bottleneck radius, E1, E2, E3, Curvature, Length, , Axis, Values..."


def folder(tmp_path, name, content, sub="md1/run/analysis"):
    d = tmp_path / sub
    d.mkdir(parents=True, exist_ok=True)
    (d / name).write_text(content)
    return str(d / name)


def test_profiles_round_trip(spark, tmp_path):
    lines = [HEADER]
    for t in (1, 2):
        for axis, values in (("X", "1, 2, 3"), ("Y", "4, 5, 6"), ("Z", "7, 8, 9"), ("distance", "0, 1, 2"), ("length", "0, 1, 2"), ("R", "1.5, 1.2, 1.1"), ("Upper limit of R overestimation", "-, -, -")):
            lines.append(f"stripped.000001.pdb, 1, {t}, 0.5, 0.69, 1.1, -, -, -, 1.2, 9.5, , {axis}, {values}")
    got = text.read_tunnels(spark, folder(tmp_path, "tunnel_profiles.csv", "\n".join(lines))).orderBy("tunnel_id").collect()
    assert len(got) == 2 and got[0].md_label == "md1" and got[0].curvature == 1.2
    assert [tuple(s) for s in got[1].spheres][1] == (1, 2.0, 5.0, 8.0, 1.0, 1.0, 1.2)
    df = spark.createDataFrame(got).withColumn("sc_id", F.lit(3))
    out = [r.line for r in reports.profile_lines(df).orderBy("tunnel_id", "k").collect()]
    assert len(out) == 14 and out[0].startswith("md1,stripped.000001.pdb,1,1,0.5,0.69,1.1,-,-,-,1.2,9.5,,X,1.0,2.0,3.0")
    again = folder(tmp_path, "sc.csv", "\n".join(["MD_traj, " + HEADER, *out]))
    assert text.read_tunnels(spark, again, with_md=True).count() == 2
    reports.write_lines(reports.profile_lines(df), str(tmp_path / "out"), ["snapshot", "tunnel_id", "k"])
    assert spark.read.text(str(tmp_path / "out")).count() == 14


def test_bottlenecks_are_ragged(spark, tmp_path):
    body = "h1\nh2, x\ns.1.pdb, 1, 2, 0.4, 0.9, 1, 2, 3, 1.1, ALA1, GLY2\ns.2.pdb, 1, 1, 0.4, 0.9, 1, 2, 3, 1.1\n"
    got = text.read_bottlenecks(spark, folder(tmp_path, "bottlenecks.csv", body)).orderBy("snapshot").collect()
    assert [r.residues for r in got] == [["ALA1", "GLY2"], []] and got[0].bz == 3.0


def test_atoms_use_the_standard_columns(spark, tmp_path):
    line = "ATOM  12345  CA  ALA A  17    -100.000  20.500   3.250  1.00  0.00           C"
    got = text.read_atoms(spark, folder(tmp_path, "x.pdb", f"MODEL 1\n{line}\nENDMDL\n"), names=["CA"]).collect()
    assert [(r.serial, r.resid, r.x, r.y, r.z) for r in got] == [(12345, 17, -100.0, 20.5, 3.25)]


def test_traces_refuse_code_and_decode_segments(spark, tmp_path):
    tokens = [2.0, 1.0, 6.0, (1.0, 0.0, 0.0), 4.0, 1.0, 2.0, 3.0, 6.0, (0.3, 0.3, 0.3), 4.0, 1.0, 1.0, 1.0, 6.0, 0.0, 0.5, 0.0, 4.0, 0.0, 0.0, 0.0, 3.0]
    d = tmp_path / "md2" / "aq"
    d.mkdir(parents=True)
    with tarfile.open(d / "data.tar.gz", "w:gz") as archive:
        raw = pickle.dumps(tokens)
        info = tarfile.TarInfo("raw_paths_3.dump")
        info.size = len(raw)
        archive.addfile(info, io.BytesIO(raw))
    got = traces.read_traces(spark, str(d / "data.tar.gz")).orderBy("ord").collect()
    assert [(r.md_label, r.path_no, r.segment, r.event_type) for r in got] == [("md2", 3, 0, "entry"), ("md2", 3, 1, "entry"), ("md2", 3, 2, "inside")]
    with pytest.raises(pickle.UnpicklingError):
        traces.PlainUnpickler(io.BytesIO(pickle.dumps(print))).load()


def test_settings(tmp_path):
    path = tmp_path / "c.ini"
    path.write_text("[CALCULATIONS_SETTINGS]\nlayer_thickness = 2.5\ncalculate_exact_path_distances = False\nclustering_linkage = average\n")
    got = text.read_config(str(path))
    assert (got.layer_thickness, got.calculate_exact_path_distances, got.clustering_linkage) == (2.5, False, "average")
    path.write_text("[CALCULATIONS_SETTINGS]\nlayer_thickness = 0.1\n")
    with pytest.raises(ValueError):
        text.read_config(str(path))


def test_report(spark):
    props = spark.createDataFrame([(1, 2, 10, 0.5), (2, 1, 5, None)], "sc_id int, num_md_sims int, num_snaps int, priority double")
    lines = reports.statistics_report(props, ["top"]).splitlines()
    assert lines[0] == "top" and lines[2].split(",")[0].strip() == "1" and lines[3].endswith("-")
    assert "999.000" in reports.distance_matrix(spark.createDataFrame([(0, 1, 0.25)], "i int, j int, dist double"), ["a", "b", "c"])


def test_frames_are_laid_on_the_reference(spark):
    import numpy as np

    from poregrid.sources.frames import FRAME_SCHEMA, superposed

    rng = np.random.default_rng(1)
    ca = rng.normal(size=(6, 3)) * 5
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    rows = [("m", f, k, "CA", "ALA", k, *map(float, turn @ ca[k] + f)) for f in (1, 2) for k in range(6)]
    got = superposed(spark.createDataFrame(rows, FRAME_SCHEMA), [(k, *map(float, ca[k])) for k in range(6)]).collect()
    assert len(got) == 12 and all(np.allclose([r.x, r.y, r.z], ca[r.atom_idx], atol=1e-6) for r in got)


def test_command_line_and_export(spark, tmp_path, capsys):
    from poregrid.cli import main
    from poregrid.operators.profiles import frame_rank

    for md, shift in (("m1", 0.0), ("m2", 0.3)):
        lines = [HEADER]
        for snap in range(1, 6):
            for cl, slope in ((1, 0.2), (2, 4.0)):
                axes = {"X": [slope * k + shift for k in range(7)], "Y": [0.0] * 7, "Z": [1.0 * k for k in range(7)], "distance": [1.0 * k for k in range(7)], "length": [1.0 * k for k in range(7)], "R": [1.2] * 7}
                for axis, values in axes.items():
                    lines.append(f"s.{snap:03d}.pdb, {cl}, 1, 0.{cl}, 0.69, 1.1, -, -, -, 1.2, 9.5, , {axis}, " + ", ".join(map(str, values)))
        folder(tmp_path, "tunnel_profiles.csv", "\n".join(lines), f"in/{md}/run/analysis")
    ini = tmp_path / "c.ini"
    ini.write_text(f"[OUTPUT_SETTINGS]\noutput_path = {tmp_path}/results\n")
    glob = f"{tmp_path}/in/*/run/analysis/*.csv"
    assert main([glob, "-c", str(ini), "-o", str(tmp_path / "report.txt")]) == 0
    assert len((tmp_path / "report.txt").read_text().splitlines()) == 6  # two simulations, two superclusters
    tunnels = text.read_tunnels(spark, glob)
    reports.export_ranked(tunnels, frame_rank(tunnels, 5), str(tmp_path / "ranked"))
    assert text.read_tunnels(spark, f"{tmp_path}/ranked/*/*.txt", folder_level=1).count() == 20
