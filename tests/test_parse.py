import pytest

from tessera.functions import contracts
from tessera.operators import graph, parse

SAMPLE = """const LIMIT = 12;

export class Basket extends Store {
  constructor(owner, limit) {
    super(owner);
    this.items = new Map();
  }

  add(item, count) {
    if (count > LIMIT) {
      throw new RangeError(`${count} of {${item}}`);
    }
    this.items.set(item, count);
  }

  static pack(items) {
    return items.reduce((b, i) => b, new Basket("none"));
  }
}

/* function hidden() {} */
export async function checkout(basket) {
  return `paid by ${basket.owner}`;
}

export const total = (basket) => basket.items.size;
"""


def brief(rows):
    return [(r["qualified_name"], r["kind"], r["signature"], r["start_line"], r["end_line"]) for r in rows]


def test_sample_file():
    assert brief(parse.parse_basic(SAMPLE, "javascript")) == [
        ("Basket", "class", "(owner, limit)", 3, 19),
        ("Basket.constructor", "method", "(owner, limit)", 4, 7),
        ("Basket.add", "method", "(item, count)", 9, 14),
        ("Basket.pack", "method", "(items)", 16, 18),
        ("checkout", "function", "(basket)", 22, 24),
    ]
    extended = parse.parse_extended(SAMPLE, "javascript")
    assert [r["qualified_name"] for r in extended] == ["LIMIT", "Basket", "Basket.constructor", "Basket.add", "Basket.pack", "checkout", "total"]
    assert extended[-1]["kind"] == "arrow_function" and extended[0]["kind"] == "constant" and extended[1]["is_exported"] and not extended[0]["is_exported"]


def test_type_parameters_do_not_hide_parents():
    rows = parse.parse_basic("class A<T, U extends V<W>> extends B.C<Map<T, U>> implements I<T>, J {\n}\n", "typescript")
    assert rows[0]["extends"] == ["B.C"] and rows[0]["implements"] == ["I", "J"]


def test_bodies_are_exact_and_brackets_in_strings_do_not_count():
    code = "// function no() {}\n/* class No {\n*/\nexport async function a(x = {y: 1}) {\n  const s = '}' + \"{\" + `}`; // }\n  if (x) { f(x); }\n}\nclass B {\n}\nclass C {\n  m(q) {\n  }\n}\n"
    rows = parse.parse_basic(code, "javascript")
    assert brief(rows) == [("a", "function", "(x = {y: 1})", 4, 7), ("B", "class", "()", 8, 9), ("C", "class", "(q)", 10, 13), ("C.m", "method", "(q)", 11, 12)]
    assert rows[0]["body"].startswith("export async function a") and rows[0]["body"].endswith("}\n}"[1:])


def test_python():
    code = 'class A(B, c.D):\n    """def no():\n    """\n    def f(self, x):\n        return g(x)\n\n    async def h(self):\n        pass\n\n\ndef top(a,\n        b):\n    return a\n'
    rows = parse.parse_basic(code, "python")
    assert brief(rows) == [("A", "class", "(B, c.D)", 1, 8), ("A.f", "function", "(self, x)", 4, 5), ("A.h", "async_function", "(self)", 7, 8), ("top", "function", "(a, b)", 11, 13)]
    assert rows[0]["extends"] == ["B", "c.D"]


def test_typescript_declarations():
    code = "export interface I extends J {\n  a: string;\n}\ntype T = string;\nexport abstract class K extends L implements I, M {\n  run(a: T): void {\n  }\n}\nenum E {\n  A\n}\nasync function* g() {\n}\n"
    basic = parse.parse_basic(code, "typescript")
    assert [(r["qualified_name"], r["kind"]) for r in basic] == [("I", "interface"), ("T", "type"), ("K", "class"), ("K.run", "method")]
    assert basic[2]["extends"] == ["L"] and basic[2]["implements"] == ["I", "M"]
    assert [(r["kind"], r["qualified_name"]) for r in parse.parse_extended(code, "typescript") if r["kind"] in ("enum", "function")][0] == ("enum", "E")


@pytest.mark.parametrize("parser", [parse.parse_basic, parse.parse_extended])
@pytest.mark.parametrize("code", ["", "\n\n", "function", "function f(", "class {", "/*", "'", "`" * 3, "def f(", "export export", "}" * 50, "(" * 2000])
def test_odd_input_never_fails(parser, code):
    for language in ("javascript", "typescript", "python", "go"):
        for r in parser(code, language):
            assert 1 <= r["start_line"] <= r["end_line"] and r["body"] is not None


def test_contract_of_a_body(spark):
    body = "function save(db) {\n  if (!db) throw new TypeError('x');\n  throw Oops;\n  db.update(a); await db.get(b); fs.writeFile(c); save(d); a.b.c(1)\n}"
    rows = [("save", body, "javascript"), ("_p", "print(x)\nrun(len(y))\n_p()", "python")]
    out = contracts.add_contract(spark.createDataFrame(rows, "name string, body string, language string")).collect()
    assert out[0]["calls"] == ["if", "TypeError", "db.update", "db.get", "fs.writeFile", "a.b.c"] and out[0]["throws"] == ["TypeError", "Oops"]
    assert out[0]["effects"] == ["database-write", "network-read", "filesystem-write"] and out[0]["properties"]["async"] and out[0]["confidence"]["effects"] == 0.85
    assert out[1]["calls"] == ["run", "_p"] and out[1]["visibility"] == "private"


def test_imports(spark):
    code = "import a, { b } from './x';\nconst c = require(\"../y\");\nfrom os.path import join\nimport sys\n"
    files = spark.createDataFrame([("r", "src/f.js", code, 0)], "repo_id string, path string, code string, file_ord long")
    got = parse.parse_imports(files).orderBy("imp_ord").collect()
    assert [r["specifier"] for r in got] == ["./x", "../y", "os.path", "sys"]
    known = spark.createDataFrame([("r", "src/x/index.js"), ("r", "y.ts"), ("r", "src/x.ts")], "repo_id string, path string")
    resolved = {r["specifier"]: (r["resolved_path"], r["confidence"]) for r in graph.resolve_imports(parse.parse_imports(files), known).collect()}
    assert resolved == {"./x": ("src/x.ts", 0.95), "../y": ("y.ts", 0.95), "os.path": (None, 0.4), "sys": (None, 0.4)}


def test_ids_survive_edits_of_neighbours(spark):
    def ids(code):
        files = spark.createDataFrame([("r", "a.js", code, "javascript", 0)], "repo_id string, path string, code string, language string, file_ord long")
        return {r["qualified_name"]: (r["symbol_id"], r["symbol_revision"]) for r in parse.parse_symbols(files).collect()}

    a, b = ids(SAMPLE), ids("// new\n" + SAMPLE.replace("paid", "settled"))
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}
    assert a["checkout"][1] != b["checkout"][1] and a["Basket.add"] == b["Basket.add"]
