"""The index without a session: walking, chunking, settings, embedders, wire format."""

import http.server
import json
import os
import pickle
import sqlite3
import threading

import numpy as np
import pytest

from tessera.cli import main, respond
from tessera.functions.text import fold_text, phrases
from tessera.operators.code_chunks import Chunk, chunk_source, line_chunks, merge_small
from tessera.operators.embed import HashingEmbedder, OllamaEmbedder, create, fetch_model, wanted_model_files, with_fallback
from tessera.operators.lexical import bm25_in_memory
from tessera.settings import Settings
from tessera.sources.corpus import CorpusSource, extension, walk


def tree(root, files):
    for name, content in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(content)


def test_walk(tmp_path):
    tree(tmp_path, {"main.go": "x", "app.py": "x", "notes.TXT": "x", "image.png": "x", "node_modules/dep.js": "x", ".git/config.txt": "x", "a/__init__.py": "x", "a/.eslintrc.json": "{}", "empty.py": "", "big.py": "x" * 100, "sub/target.go": "x", "a/target/x.go": "x"})
    got = [c.path for c in walk(str(tmp_path), max_file_size=50)]
    assert got == ["a/.eslintrc.json", "a/__init__.py", "app.py", "main.go", "notes.TXT", "sub/target.go"]
    assert [c.path for c in walk(str(tmp_path), [".png"], [])] == ["image.png"]
    os.symlink(tmp_path, tmp_path.parent / "link")
    assert len(list(walk(str(tmp_path.parent / "link"), max_file_size=50))) == 6
    assert extension(".py") == ".py" and extension("a.tar.GZ") == ".gz" and extension("Makefile") == ""


@pytest.mark.parametrize("folders", [1, 2, 3, 5, 100])
def test_partitions_hold_what_a_walk_finds(tmp_path, folders):
    """Every file once, however many folders are left to the executors."""
    tree(tmp_path, {f"a{i}/b{j}/c{k}/f{n}.py": "x" * (n + 1) for i in range(2) for j in range(2) for k in range(i + 1) for n in range(3)} | {"top.py": "x", "a0/x.md": "y", "node_modules/n.js": "z", "a1/.git/g.py": "z", "a1/e.py": ""})
    reader = CorpusSource({"path": str(tmp_path), "folders": str(folders), "filesinpartition": "2"}).reader(None)
    parts = reader.partitions()
    got = [row for p in pickle.loads(pickle.dumps(parts)) for row in reader.read(p)]
    assert sorted(r[0] for r in got) == sorted(c.path for c in walk(str(tmp_path))) and len(got) == 20
    assert all(len(content) == size and error is None for _, size, _, content, error in got)
    assert sum(bool(p.folder) for p in parts) == {1: 1, 2: 2, 3: 4, 5: 6}.get(folders, 0)


def symbols(chunks):
    return [c.symbol for c in chunks]


def test_small_files_keep_their_declarations():
    assert chunk_source("a.txt", b"") == [] and symbols(chunk_source("a.txt", "one\ntwo\n")) == [""]
    go = 'package svc\n\nimport "fmt"\n\ntype Server struct {\n\taddr string\n}\n\nfunc New() *Server {\n\treturn &Server{}\n}\n\nfunc (s *Server) Serve() error {\n\tfmt.Println("}")\n\treturn nil\n}\n'
    assert symbols(chunk_source("a.go", go)) == ["", "Server", "New", "Serve"]
    py = "import os\n\n# note\ndef parse_config(p):\n    return p\n\n@dec(1)\nclass A:\n    pass\n\nclass Handler:\n    def run(self):\n        pass\n"
    got = chunk_source("x/a.py", py)
    assert [s for s in symbols(got) if s][-3:] == ["parse_config", "A", "Handler"] and got[-2].content.startswith("@dec")
    ts = "export interface User {\n  id: ID;\n}\n\nexport type ID = string;\n\nexport class Repo {\n  find(id: ID): User { return null; }\n}\nconst f = () => {\n  return `}${1}`\n}\n"
    assert symbols(chunk_source("a.ts", ts)) == ["User", "ID", "Repo", ""]
    assert symbols(chunk_source("a.cs", "namespace Game\n{\n    public class P { }\n}\n")) == ["Game"]


def test_csharp_descends():
    src = 'using System;\nusing System.Linq;\n\nnamespace Game\n{\n    public class Player : Base\n    {\n        private int health = 3;\n        private int stamina;\n\n        public void Jump()\n        {\n            Log("}");\n        }\n\n        [Attr]\n        public int Attack(int x) => x;\n    }\n}\n'
    got = chunk_source("P.cs", src, 8, 2)
    assert symbols(got)[:3] == ["", "Game", "Game.Player"] and {"Game.Player.Jump", "Game.Player.Attack"} <= set(symbols(got))
    assert got[0].content == "using System;\nusing System.Linq;"
    region = "namespace Game\n{\n    public class Tools\n    {\n#if UNITY_EDITOR\n        public void DrawGizmos()\n        {\n            Paint(1);\n            Paint(2);\n        }\n\n        public void Validate()\n        {\n            Check(1);\n            Check(2);\n        }\n#endif\n    }\n}\n"
    assert {"Game.Tools.DrawGizmos", "Game.Tools.Validate"} <= set(symbols(chunk_source("T.cs", region, 8, 2)))
    scoped = "namespace Game.Core;\n\npublic interface IDamageable\n{\n    void TakeDamage(int amount);\n}\n\npublic enum Rarity\n{\n    Common,\n    Rare,\n}\n"
    assert symbols(chunk_source("C.cs", scoped)) == ["Game.Core", "IDamageable", "Rarity"]


def test_oversized_declarations_are_cut():
    got = chunk_source("big.go", "package big\n\nfunc Huge() {\n" + "\tprintln(1)\n" * 30 + "}\n", 5, 1)
    huge = [c for c in got if c.symbol == "Huge"]
    assert len(huge) > 1 and all(c.end_line - c.start_line < 5 for c in huge)
    got = chunk_source("h.py", "class H:\n    x = 1\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(4)), 4, 1)
    assert symbols(got)[0] == "H" and "H.m3" in symbols(got)
    assert symbols(chunk_source("bad.py", "def broken(:\n")) == [""]


def test_line_windows_and_merging():
    assert [(c.start_line, c.end_line) for c in line_chunks("l1\nl2\nl3\nl4\nl5\nl6\n", max_lines=3, overlap=1)] == [(1, 3), (3, 5), (5, 6)]
    assert line_chunks("\n \n") == [] and len(line_chunks("a\n" * 10, max_lines=2, overlap=5)) == 9
    with pytest.raises(ValueError):
        line_chunks("a", max_lines=0)
    got = merge_small([Chunk(1, 1, "", "package svc"), Chunk(3, 3, "", 'import "fmt"'), Chunk(5, 12, "Foo", "func Foo() {}"), Chunk(13, 13, "", "x")])
    assert got == [Chunk(1, 3, "", 'package svc\nimport "fmt"'), Chunk(5, 12, "Foo", "func Foo() {}"), Chunk(13, 13, "", "x")]


def test_settings():
    s = Settings.from_env({})
    assert (s.embed_provider, s.embed_dim, s.low_priority) == ("hashing", 256, True) and 1 <= s.index_concurrency <= 4
    s = Settings.from_env({"TESSERA_INDEX_DIR": "/x", "TESSERA_EMBED_PROVIDER": "onnx", "TESSERA_EMBED_DIM": "8", "TESSERA_LOW_PRIORITY": "0", "TESSERA_EMBED_MODEL": ""})
    assert (s.index_dir, s.embed_dim, s.low_priority) == ("/x", 8, False) and s.embed_model
    for bad in ({"EMBED_PROVIDER": "x"}, {"EMBED_DIM": "no"}, {"EMBED_DIM": "0"}, {"INDEX_CONCURRENCY": "-1"}, {"LOW_PRIORITY": "maybe"}):
        with pytest.raises(ValueError):
            Settings.from_env({f"TESSERA_{k}": v for k, v in bad.items()})
    assert s.index_path("/a") == s.index_path("/a/") != s.index_path("/b")


class Fake(http.server.BaseHTTPRequestHandler):
    status, short = 200, False

    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        body = json.dumps({"embeddings": [[float(i + 1)] * 3 for i in range(len(texts) - (Fake.short and len(texts) > 1))]}).encode()
        self.send_response(Fake.status)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        return None


def test_embedders():
    server = http.server.HTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = OllamaEmbedder(f"http://127.0.0.1:{server.server_port}/", "m")
    assert e.dim == 3 and e.embed(["a", "b"]) == [[1.0] * 3, [2.0] * 3] and e.embed([]) == []
    Fake.short = True
    with pytest.raises(RuntimeError):
        e.embed(["a", "b"])
    Fake.short, Fake.status = False, 500
    with pytest.raises(OSError):
        e.embed(["a"])
    server.shutdown()
    h = HashingEmbedder(16)
    v = h.embed(["Été été", "ete", ""])
    assert v[0] == pytest.approx(v[1]) and sum(x * x for x in v[0]) == pytest.approx(1) and v[2] == [0.0] * 16
    assert create(Settings(embed_dim=9)).dim == 9

    def run(texts):
        if len(texts) > 1 or len(texts[0]) > 508:
            raise RuntimeError
        return [[float(len(texts[0]))]]

    assert with_fallback(run, ["a" * 600, "日本語テスト"]) == [[508.0], [6.0]]
    files = ["onnx/model.onnx", "onnx/model.onnx_data", "onnx/other.onnx", "config.json", "vocab.txt", "1_Pooling/config.json", "2/x.json"]
    assert wanted_model_files(files, "onnx/model.onnx") == ["onnx/model.onnx", "onnx/model.onnx_data", "config.json", "vocab.txt", "1_Pooling/config.json"]
    with pytest.raises(ValueError):
        wanted_model_files(files, "none.onnx")


def field(number, value):
    """One field of a protobuf message: a number, or bytes."""
    whole = lambda n: bytes([n & 127 | 128]) + whole(n >> 7) if n > 127 else bytes([n])
    return whole(number << 3) + whole(value) if isinstance(value, int) else whole(number << 3 | 2) + whole(len(value)) + value


def lookup_model(weights):
    """An ONNX model whose hidden states are rows of ``weights`` by token id."""
    def tensor(name, kind, *dims):
        shape = b"".join(field(1, field(2, d.encode()) if isinstance(d, str) else field(1, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    node = field(1, b"weights") + field(1, b"input_ids") + field(2, b"hidden") + field(4, b"Gather")
    values = field(1, weights.shape[0]) + field(1, weights.shape[1]) + field(2, 1) + field(8, b"weights") + field(9, weights.astype("<f4").tobytes())
    graph = field(1, node) + field(2, b"g") + field(5, values)
    graph += b"".join(field(11, tensor(x, 7, "batch", "tokens")) for x in (b"input_ids", b"attention_mask")) + field(12, tensor(b"hidden", 1, "batch", "tokens", weights.shape[1]))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def test_onnx_embedder(tmp_path):
    """A model of looked-up rows: means over a text's own tokens, without padding, of unit length; long texts are cut."""
    pytest.importorskip("onnxruntime")
    tokenizers = pytest.importorskip("tokenizers")
    folder = tmp_path / "some" / "model"
    os.makedirs(folder / "onnx")
    words = ["[UNK]", "red", "green", "blue"]
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.save(str(folder / "tokenizer.json"))
    weights = np.array([[0, 0, 0.5], [3, 0, 0], [0, 4, 0], [1, 1, 1]])
    (folder / "onnx" / "model.onnx").write_bytes(lookup_model(weights))
    e = create(Settings(embed_provider="onnx", embed_model="some/model", model_dir=str(tmp_path)))
    unit = lambda rows: np.mean([weights[i] for i in rows], axis=0) / np.linalg.norm(np.mean([weights[i] for i in rows], axis=0))
    got = e.embed(["red green", "blue", "red red red what", "red " * 300 + "green " * 300])
    assert e.dim == 3 and np.allclose(got[:3], [unit([1, 2]), unit([3]), unit([1, 1, 1, 0])], atol=1e-6)
    assert np.allclose(got[3], e.embed([("red " * 300)[:1024]])[0])


class Hub(http.server.BaseHTTPRequestHandler):
    files = {"onnx/model.onnx": b"weights", "onnx/other.onnx": b"no", "config.json": b"{}", "tokenizer.json": b"{1}", "weights.bin": b"no"}
    asked: list = []
    broken = ""

    def do_GET(self):
        Hub.asked.append(self.path)
        name = self.path.split("/resolve/main/")[-1]
        body = json.dumps({"siblings": [{"rfilename": x} for x in Hub.files]}).encode() if self.path == "/api/models/a/m" else Hub.files.get(name)
        self.send_response(200 if body and name != Hub.broken else 404)
        self.end_headers()
        self.wfile.write(body or b"")

    def log_message(self, *_):
        return None


def test_model_files_are_fetched_once(tmp_path):
    server = http.server.HTTPServer(("127.0.0.1", 0), Hub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host, folder = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "a" / "m")
    Hub.broken = "tokenizer.json"
    with pytest.raises(OSError):
        fetch_model("a/m", folder, "onnx/model.onnx", host)
    Hub.broken = ""
    fetch_model("a/m", folder, "onnx/model.onnx", host)
    assert fetch_model("a/m", folder, "onnx/model.onnx", host) == []
    found = {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}
    assert found == {k: Hub.files[k] for k in ("onnx/model.onnx", "config.json", "tokenizer.json")}
    assert Hub.asked.count("/a/m/resolve/main/onnx/model.onnx") == 1
    with pytest.raises(ValueError, match="other.onnx"):
        fetch_model("a/m", folder, "none.onnx", host)
    Hub.files["../out.json"] = b"x"
    fetch_model("a/m", folder, "onnx/model.onnx", host)
    assert not os.path.exists(tmp_path / "a" / "out.json")
    server.shutdown()


def test_query_phrases():
    assert phrases("parse_config(x) Parse café _ ") == [["parse", "config"], ["x"], ["parse"], ["caf"]]
    assert fold_text("ÉTÉ e\u0301 ß ñ") == "ete e ß n"


def test_bm25_against_sqlite():
    texts = {1: "func ParseConfig(path string)", 2: "parse the config, parse again", 3: "def parse_config(x): return x", 4: "nothing here", 5: "", 6: "Café parse"}
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(content)")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    db.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", texts.items())
    import re

    rows = {i: re.findall(r"[^\W_]+", fold_text(t)) for i, t in texts.items()}
    for q in ("parse", "parse config", "parse_config", "parse parse", "cafe", "ParseConfig", "conf"):
        match = " OR ".join(f'"{w}"*' for w in re.findall(r"[A-Za-z0-9_]+", q))
        want = {i: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        assert bm25_in_memory(rows, q) == {i: pytest.approx(s, abs=1e-9) for i, s in want.items()}, q


def test_wire():
    class Engine:
        def status(self, path):
            return {"root": path, "phase": "idle"}

    ask = lambda **x: json.loads(respond(Engine(), json.dumps(x)))
    assert len(ask(id=1, method="tools/list")["result"]["tools"]) == 4
    assert ask(id=2, method="tools/call", params={"name": "get_indexing_status", "arguments": {"path": "/x"}})["result"]["structuredContent"]["phase"] == "idle"
    assert "path is required" in ask(id=3, method="tools/call", params={"name": "get_indexing_status"})["error"]["message"]
    assert "error" in json.loads(respond(Engine(), "not json")) and respond(Engine(), json.dumps({"method": "notifications/initialized"})) is None
    assert ask(id=4, method="nope")["error"]["code"] == -32601
    with pytest.raises(SystemExit) as e:
        main(["frobnicate"])
    assert e.value.code == 2
