import unicodedata

from pyspark.sql import functions as F

from tessera.functions import identity, paths, text, tokens


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def sym(spark, path, kind, name, signature, language="javascript"):
    return one(spark, identity.symbol_id(F.lit(path), F.lit(language), F.lit(kind), F.lit(name), F.lit(signature)))


def test_known_identities(spark):
    sample = "test/fixtures/sample.js"
    assert sym(spark, sample, "function", "hello", "(name)") == "sym_629ecc448e1e"
    assert sym(spark, sample, "class", "Greeter", "(greeting)") == "sym_b5831d6ac6c9"
    assert sym(spark, sample, "method", "Greeter.constructor", "(greeting)") == "sym_a7e8c86f2280"
    assert sym(spark, sample, "method", "Greeter.greet", "(name)") == "sym_6d737a60d334"
    assert sym(spark, sample, "method", "Greeter.create", "()") == "sym_e92d1a91473e"
    assert one(spark, identity.compat_symbol_id(F.lit("javascript"), F.lit("hello"))) == "sym_69c52b645167"


def test_one_identity_for_all_forms_of_a_path(spark):
    for path in ("src/café.js", unicodedata.normalize("NFD", "src/café.js"), "src\\café.js"):
        assert sym(spark, path, "function", "café.run", "run()") == "sym_123d3724242b"


def test_known_revisions(spark):
    assert one(spark, identity.file_revision(F.lit("const x = 1;\nconst y = 2;\n"))) == "dbdb3e344ac7"
    assert one(spark, identity.symbol_revision(F.lit("function foo() { return 1; }"), F.lit("function foo()"))) == "907af9c27e32"
    assert one(spark, identity.content_hash(F.lit("test content"))).startswith("6ae8a755")
    assert one(spark, identity.subtree_revision(F.lit(""))) == identity.NO_REVISION


def test_ordinals_and_signatures(spark):
    key = identity.symbol_key(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit(" async  x(\n y ) "), F.lit(2))
    assert one(spark, key) == "a|b|c|d|x( y )|#2"
    assert one(spark, identity.symbol_key(F.lit(None).cast("string"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit(None).cast("string"))) == "|b|c|d||"


def test_subtrees():
    tree = {"kind": "class", "name": "A", "qualifiedName": "A", "children": [{"kind": "method", "name": "f", "qualifiedName": "A.f", "signature": "async  f( )"}, None]}
    assert identity.normal_subtree(tree) == "class|A|A|method|f|A.f|f( )|"
    assert identity.normal_subtree(None) == ""


def test_utf16_and_rounding(spark):
    assert one(spark, text.utf16_length(F.lit("a😀"))) == 3
    assert one(spark, text.round_half_up(F.lit(2.675))) == 2.68 and one(spark, text.round_half_up(F.lit(-0.5), 0)) == 0


def test_token_estimates(spark):
    assert [one(spark, tokens.packet_tokens(F.lit(t), k)) for t, k in (("", "json"), ("abcd", "code"), ("abcd", "odd"))] == [1, 2, 1]
    assert [one(spark, tokens.server_tokens(F.lit(t), k)) for t, k in (("", "json"), ("abcd", "text"), ("abcd", "odd"))] == [0, 3, 3]
    assert one(spark, tokens.model_tokens(F.lit("abcde"), "mythos-nano")) == 5
    none = F.lit(None)
    assert one(spark, tokens.rank_tokens(none.cast("string"), none.cast("string"), none.cast("array<string>"), none, none)) == 20
    full = one(spark, tokens.full_allocation(F.lit(32000), F.lit("safe")))
    assert full["contracts"] == full["sources"] == 6720 and full["instructions"] == 1600


def test_languages_and_containment(spark):
    def language(path):
        return one(spark, paths.language(F.lit(path)))

    assert [language(p) for p in ("a.JS", "x/b.tsx", "c.pyi", ".js", "d", "e.tar.md", "dir.py/f")] == ["javascript", "tsx", "python", "text", "text", "markdown", "text"]
    inside = lambda p: one(spark, paths.inside(F.lit("/r"), F.lit(p)))
    assert [inside(p) for p in ("/r", "/r/a", "/rr/a", "/")] == [True, True, False, False]
    assert one(spark, paths.safe_patch_id(F.lit("p_1"))) and not one(spark, paths.safe_patch_id(F.lit("a/../b")))


def test_canonical_paths(spark):
    c = lambda p: one(spark, paths.canonical(F.lit("/repo"), F.lit(p)))
    assert c("./a/./b//c.js")["path"] == "a/b/c.js" and c("/repo/x/../y.js")["path"] == "y.js"
    assert c(unicodedata.normalize("NFD", "é.js"))["path"] == "é.js"
    assert c("../x")["error"].startswith("PATH_OUTSIDE_REPOSITORY") and c("/repository/x")["error"].startswith("PATH_OUTSIDE_REPOSITORY")
    assert c(".")["error"].startswith("INVALID_REPOSITORY_PATH")
