"""The command line, over one archive and several."""

import json

import pytest

from veilmark import cli
from veilmark.kinds import PolicyError, ResidualPiiError
from veilmark.sources import archives as containers

TEXT = "DUMP OF SERVICE account:\nAccount {name=ida.quill@post.example.org, type=com.google}\n"


@pytest.fixture()
def folder(tmp_path, spark):
    (tmp_path / "in").mkdir()
    for name, more in (("a.zip", ""), ("b.zip", "again ida.quill@post.example.org\n")):
        (tmp_path / "in" / name).write_bytes(containers.zip_bytes([("dumpstate.txt", (TEXT + more).encode()), ("version.txt", b"2.0"), ("p.png", b"x")]))
    (tmp_path / "key").write_bytes(b"\x05" * 32)
    return tmp_path


def opened(path):
    return dict(containers.zip_members(path.read_bytes()))


def test_several_archives(folder):
    assert cli.run(["-i", f"{folder}/in", "-o", f"{folder}/out", "--key-file", f"{folder}/key"]) == 0
    a, b = (opened(folder / "out" / n) for n in ("a.zip", "b.zip"))
    assert sorted(a) == ["dumpstate.txt", "version.txt"] and b"ida.quill" not in a["dumpstate.txt"] + b["dumpstate.txt"]
    name = a["dumpstate.txt"].split(b"name=")[1].split(b",")[0]
    assert name.endswith(b".invalid") and b["dumpstate.txt"].count(name) == 2  # one key for all
    report = json.loads((folder / "out" / "b-report.json").read_text())
    assert report["residual_scan"]["status"] == "clean" and [m["path"] for m in report["members_dropped"]] == ["p.png"]
    assert "dropped" in (folder / "out" / "a-report.md").read_text().lower()


def test_sealed_and_restored(folder):
    one = f"{folder}/in/b.zip"
    assert cli.run(["-i", one, "-o", f"{folder}/sealed.zip", "--reversible", "--key-file", f"{folder}/key"]) == 0
    assert b"vm1." in opened(folder / "sealed.zip")["dumpstate.txt"]
    assert cli.run(["-i", f"{folder}/sealed.zip", "-o", f"{folder}/back.zip", "--restore", "--key-file", f"{folder}/key"]) == 0
    assert opened(folder / "back.zip")["dumpstate.txt"] == opened(folder / "in" / "b.zip")["dumpstate.txt"]


def test_told_without_writing(folder, capsys):
    assert cli.run(["--list-entities", "--only", "email"]) == 0 and "(outside --only)" in capsys.readouterr().out
    assert cli.run(["--contract-test"]) == 0
    capsys.readouterr()
    assert cli.run(["-i", f"{folder}/in/a.zip", "--explain"]) == 0 and "DROP p.png" in capsys.readouterr().out
    (folder / "left.zip").write_bytes(containers.zip_bytes([("dumpstate.txt", b"near de:ad:be:ef:00:01 and 52.123456, 4.123456")]))
    assert cli.run(["-i", f"{folder}/left.zip", "--verify"]) == 1 and "mac_address: 1" in capsys.readouterr().out
    with pytest.raises(ResidualPiiError):
        cli.run(["-i", f"{folder}/left.zip", "-o", f"{folder}/x.zip"])
    assert not (folder / "x.zip").exists()
    for argv in ([], ["-i", "x"], ["-i", f"{folder}/in/a.zip", "-o", "y", "--vault", "v"]):
        with pytest.raises(Exception) as e:  # noqa: PT011
            cli.run(argv)
        assert isinstance(e.value, PolicyError) or argv == ["-i", "x"]


def test_exit_codes(monkeypatch, capsys):
    def fails(error):
        def run(argv):
            raise error

        monkeypatch.setattr(cli, "run", run)
        with pytest.raises(SystemExit) as e:
            cli.main()
        return e.value.code

    assert fails(ResidualPiiError("left")) == 1 and fails(PolicyError("what")) == 3 and fails(OSError("gone")) == 3
