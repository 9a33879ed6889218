"""The flows of the command line, from files to files."""

import pytest

from seqrank.__main__ import main
from seqrank.plans import pipelines
from seqrank.sources import tables


def test_flows_end_to_end(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    sequences = [f"{'ACDEFGHIKL' * 3}{'GASAG' if i % 2 else 'AAAAA'}{'MNPQRSTVWY' * (2 + i % 3)}" for i in range(6)]
    (tmp_path / "in.fasta").write_text("".join(f">s{i} x\n{s}\n" for i, s in enumerate(sequences)))
    (tmp_path / "wt.csv").write_text("sequence\n" + "\n".join(sequences[:2]) + "\n")
    distinct = sorted(set(sequences))
    (tmp_path / "ll.csv").write_text("sequence,ll\n" + "".join(f"{s},-{k}.5\n" for k, s in enumerate(distinct)))
    (tmp_path / "delta.csv").write_text("sequence,wt_cosine_sim\n" + "".join(f"{s},0.9\n" for s in distinct))
    (tmp_path / "kin.csv").write_text("sequence,kcat,km,expression\nAC,2,5,0.5\nAD,1,bad,1\n")
    main(["cluster", "--input", at("in.fasta"), "--out-clusters", at("c.csv"), "--out-reps", at("r.csv")], spark)
    main(["wild-types", "--clusters", at("c.csv"), "--wt", at("wt.csv"), "--out-clusters", at("w.csv"), "--out-sequences", at("sw.csv")], spark)
    main(["properties", "--input", at("in.fasta"), "--output", at("p.csv")], spark)
    main(["zero-shot", "--input", at("in.fasta"), "--clusters", at("c.csv"), "--reps", at("r.csv"), "--likelihood", at("ll.csv"), "--delta", at("delta.csv"), "--output", at("z.csv")], spark)
    main(["final-score", "--input", at("delta.csv"), "--output", at("f.csv"), "--style", "aggressive"], spark)
    main(["kinetics", "--input", at("kin.csv"), "--output", at("k.csv"), "--s0", "10", "--expression-as-enzyme"], spark)
    read = lambda name: tables.read_csv(spark, at(name))
    assert read("c.csv").count() == len(distinct) and read("sw.csv").count() == len(distinct)
    assert read("w.csv").filter("wt_id >= 0").count() == 2
    assert "z_iep" in read("p.csv").columns and read("p.csv").count() == 6
    assert read("z.csv").columns == ["sequence", *pipelines.OFFICIAL.values()] and read("z.csv").filter("`expression (mg/mL)` is null").isEmpty()
    assert read("f.csv").count() == len(distinct) and {"activity_1", "expression"} <= set(read("f.csv").columns)
    got = {r["sequence"]: r["v0"] for r in read("k.csv").collect()}
    assert float(got["AC"]) == pytest.approx(2 * 60 * (0.5 / 30000) * 10 / 15) and got["AD"] is None
    with pytest.raises(SystemExit):
        main(["nothing"], spark)
