"""The command line: files in, files out, exit codes."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from treeloom.cli import main

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize(("name", "text"), [("a.css", "a{b:'(c)\\\n'}"), ("a.html", "<p>é<br/><script>'</p>'</script>"), ("a.json", '{"a":[1.50e1,"\\""]}'), ("a.yml", "a: {b: [1, 2]} # c\n"), ("a.md", "# h\n\n- x\n"), ("a.ini", "[s]\nk = v\n"), ("a.py", "def f():\n\treturn 1\n"), ("a.js", "a = /x[/]/g;"), ("a.vds", "<a> | b{1,2}")])
def test_tree_and_back(tmp_path, name, text):
    source = tmp_path / name
    source.write_bytes(text.encode())
    assert main(["auto", str(source)]) == 0
    made = next(p for p in tmp_path.iterdir() if p.suffix == ".aif")
    assert main(["render", str(made), str(tmp_path / "back")]) == 0
    assert (tmp_path / "back").read_bytes() == text.encode()


def test_check(tmp_path, capsys):
    bad = tmp_path / "a.css"
    bad.write_text("a{b}")
    assert main(["check", str(bad)]) == 1
    assert "error[expected-colon]" in capsys.readouterr().out
    assert main(["check", str(bad), "--diagnostics", "json"]) == 1
    assert json.loads(capsys.readouterr().out)[0]["code"] == "expected-colon"
    nim = tmp_path / "a.nim"
    nim.write_text("if x == true:\n  echo x\n")
    assert main(["check", str(nim), "--lint", "idioms"]) == 0
    assert "redundant-bool-literal" in capsys.readouterr().out
    assert main(["parse", str(nim), str(tmp_path / "t.aif")]) == 0
    assert b"(if" in (tmp_path / "t.aif").read_bytes()
    nim.write_text("let x == (1\n")
    assert main(["parse", str(nim), "--strict", "--stdout"]) == 1
    assert main(["auto", str(tmp_path / "none.zip")]) == 1
    (tmp_path / "b.zip").write_text("")
    assert main(["auto", str(tmp_path / "b.zip")]) == 1


def test_json_and_completeness(tmp_path, capsysbinary):
    f = tmp_path / "a.json"
    f.write_text('{"a":[{"n":1.5e3}],"s":"\\u00e9","t":true}')
    for path, code, out in (("a[0].n", 0, b"1.5e3\n"), ("s", 0, "é\n".encode()), ("a", 0, b"[1 elements]\n"), ("t", 0, b"true\n"), ("z", 1, b""), ("a[x]", 2, b"")):
        assert main(["jsonq", str(f), path]) == code
        assert capsysbinary.readouterr().out == out
    assert main(["jsonlint", str(f)]) == 0
    f.write_text('{"a":\n 01}')
    assert main(["jsonlint", str(f)]) == 1
    assert b":2:3: error:" in capsysbinary.readouterr().out
    for text, code in (("x + 1", 0), ("foo(", 2), ("foo)", 1)):
        f.write_text(text)
        assert main(["complete", str(f)]) == code
    assert main(["dialects"]) == 0
    assert capsysbinary.readouterr().out.count(b"\n") >= 9


def test_module_reads_standard_input():
    done = subprocess.run([sys.executable, "-m", "treeloom", "css", "-"], input=b"a{}", capture_output=True, cwd=ROOT, timeout=60)
    assert done.returncode == 0 and b'(.dialect "css-parsed")' in done.stdout


def test_depth_and_paths(tmp_path, capsys, monkeypatch):
    (tmp_path / "sub").mkdir()
    source = tmp_path / "sub" / "a.css"
    source.write_text("a{}\n@x{@y{b{c}}}")
    monkeypatch.chdir(tmp_path)
    assert main(["check", "sub/../sub/a.css", "--max-depth", "3"]) == 1
    assert capsys.readouterr().err == "sub/a.css: nesting is deeper than --max-depth 3 at line 2\n"
    assert main(["check", str(source)]) == 1 and capsys.readouterr().out.startswith("sub/a.css:2:")
    assert main(["check", str(source), "--portable-paths", "off"]) == 1 and capsys.readouterr().out.startswith(str(source))
    monkeypatch.chdir(tmp_path / "sub")
    other = tmp_path / "b.css"
    other.write_text("}")
    assert main(["check", str(other)]) == 1 and capsys.readouterr().out.startswith(str(other))
