import json

import pytest

from equirank import __main__ as cli


def test_options(spark, sf, tmp_path, capfd):
    cli.main(["list"])
    assert "parity_per_query" in capfd.readouterr().out.split()
    cli.main(["run", "label_census", "--data", sf])
    assert "privileged" in capfd.readouterr().out
    cli.main(["run", "label_census", "--data", sf, "--out", str(tmp_path / "c.json"), "--format", "document"])
    assert {r["label"] for r in json.loads((tmp_path / "c.json").read_text())} == {"privileged", "underrepresented", "unknown"}
    for extra, masked in (([], True), (["--allow-unjudged"], False)):
        out = str(tmp_path / f"sweep{len(extra)}")
        cli.main(["sweep", "--data", sf, "--lambdas", "0.3,1.0", "--out", out, *extra])
        rows = {r["lam"]: r for r in spark.read.parquet(out).collect()}
        assert set(rows) == {0.3, 1.0} and (rows[0.3]["mrr"] is None) == masked and rows[1.0]["mrr"] is not None
    with pytest.raises(SystemExit):
        cli.main(["run", "no_such_query", "--data", sf])
