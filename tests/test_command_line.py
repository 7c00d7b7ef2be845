import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def run(*args, stdin=""):
    out = subprocess.run([sys.executable, "-m", "tessera", *map(str, args)], input=stdin, capture_output=True, text=True, cwd=ROOT)
    return out.returncode, out.stdout, out.stderr


def test_format(tmp_path):
    assert run("format", stdin="SELECT 1;")[:2] == (0, "select 1;\n")
    (tmp_path / "a.sql").write_text("select 1;\n")
    (tmp_path / "b.sql").write_text("SELECT 1;\n")
    (tmp_path / ".x").mkdir()
    (tmp_path / ".x" / "c.sql").write_text("SELECT 1;\n")
    assert run("format", "-l", tmp_path)[1].split() == [str(tmp_path / "b.sql")]
    assert "-SELECT 1;" in run("format", "-d", tmp_path)[1]
    (tmp_path / "d.sql").write_text("'open")
    assert run("format", tmp_path)[0] == 2 and run("nothing")[0] == 2


def test_format_in_place(tmp_path):
    (tmp_path / "a.sql").write_text("SELECT 1;\n")
    (tmp_path / "b.sql").write_text("select 2;\n")
    assert run("format", "-w", "-l", tmp_path)[:2] == (0, f"{tmp_path / 'a.sql'}\n")
    assert (tmp_path / "a.sql").read_text() == "select 1;\n" and run("format", "-l", tmp_path)[1] == ""
    assert run("format", "-w", stdin="SELECT 1;")[0] == 2
    assert run("-V")[1].startswith("tessera ")


def test_plans(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text(" Seq Scan on t\n")
    b.write_text(" Index Scan using i on t\n")
    assert run("advice", a)[1] == "JOIN_ORDER(t)\nSEQ_SCAN(t)\nNO_GATHER(t)\n"
    assert run("diff", a, a)[0] == 0 and run("diff", a, b)[0] == 1 and run("diff", a, tmp_path / "c")[0] == 2
    assert run("canonical", stdin="SEQ_SCAN(z s.a)\n")[1] == "SEQ_SCAN(a z)\n"
    assert '"Node Type": "Seq Scan"' in run("json", a)[1] and run("narrow", 60, a)[1] == " Seq Scan on t\n"
    assert run("json", stdin="")[0] == 2
