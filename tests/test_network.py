"""Hand-made examples of the network operators."""

import math
import random

import duckdb
import pandas as pd
import pytest

from quillnet.operators import cooccur, graph, mentions, report, resolve, sanitize, spans
from quillnet.plans import fixtures, lifecycle, queries
from quillnet.sources import annotated, networks
from tests.compare import rows

HAND = [("doc1", 0, e) for e in "AB"] + [("doc1", 1, e) for e in "ABC"] + [("doc1", 2, "D")] + [("doc2", 0, e) for e in "AB"] + [("doc2", 1, e) for e in "CD"] + [("doc2", 1, "D")]

# expected folds, traced by hand from the rules
CHAINS = [
    (["Lloyd 's", "Lloyd 's Bank"], ["Lloyd 's Bank 0 1"]),
    (["Warners", "Warner-Lambert Co .", "Warner-Lambert 's"], [None, "Warner-Lambert 's 0 0"]),
    (["The Ringing World", "TRW", "TRW Inc."], ["The Ringing World 0 0", None]),
    (["News Corp.", "Detroit News"], ["Detroit News 1 0"]),
    (["Northeast Utilities", "Utilities", "Northeast"], ["Northeast Utilities 1 0", "Northeast Utilities 1 1"]),
    (["Time Warner", "Warner Bros."], ["Warner Bros. 1 0"]),
    (["Times-Stock Exchange", "Exchange"], ["Times-Stock Exchange 1 0"]),
    (["Toronto Stock Exchange", "Stock Exchange"], ["Toronto Stock Exchange 1 0"]),
    (["Deseret Bancorp.", "Deseret", "Deseret Bank"], ["Deseret Bancorp. 0 1", None]),
    (["Deloitte", "Deloitte-Touche", "Deloitte and Touche"], ["Deloitte-Touche 0 0", "Deloitte and Touche 0 0"]),
    (["Christie 's", "Christie 's International PLC"], ["Christie 's International PLC 0 1"]),
    (["Young 's Market Co.", "Young 's"], ["Young 's Market Co. 0 1"]),
    (
        ["A&P Company", "The Atlantic and Pacific Company", "Atlantic and", "The Great Atlantic and Pacific Tea Company", "The Atlantic and Pacific Company", "A&P", "Great Atlantic & Pacific", "A&P", "Atlantic and"],
        ["The Atlantic and Pacific Company 0 0", "The Atlantic and Pacific Company 0 1", *["The Great Atlantic and Pacific Tea Company 1 2"] * 2, None, "The Great Atlantic and Pacific Tea Company 1 2", None, "The Great Atlantic and Pacific Tea Company 1 2"],
    ),
]


def edges_of(spark):
    m = mentions.interesting(mentions.distinct_mentions(spark.createDataFrame(HAND, "doc string, sent int, ent string")))
    return cooccur.npmi_edges(m)


def test_npmi_by_hand(spark):
    got = {(r["a"], r["b"]): (r["sentences"], r["documents"], round(r["npmi"], 6)) for r in edges_of(spark).collect()}
    assert got == {("A", "B"): (3, 2, 1.0), ("A", "C"): (1, 1, 0.184535), ("B", "C"): (1, 1, 0.184535), ("C", "D"): (1, 1, 0.684535)}
    ranked = cooccur.rank_edges(edges_of(spark)).orderBy("rank").collect()
    assert [r["a"] + r["b"] for r in ranked] == ["AC", "BC", "CD", "AB"]


def test_default_filters_empty_the_small_graph(spark):
    nodes, strong = graph.filtered_graph(edges_of(spark))
    assert nodes.count() == 0 and strong.count() == 0


@pytest.mark.parametrize("names, expected", CHAINS)
def test_alias_chains(names, expected):
    entity, got = resolve.Entity(names[0]), []
    for name in names[1:]:
        got.append(f"{entity.key} {entity.front} {entity.back}" if resolve.alias_step(entity, name) else None)
    assert got == expected


def test_fold_tries_every_entity_that_may_fit():
    r = random.Random(3)
    words = "Acme Bolt of and The Co. Inc. International Business Machines IBM A&P Time-Warner . & 's Sachs U.S. World PLC a I.B.M.".split()
    names = {}
    for _ in range(150):
        x = " ".join(r.choice(words) for _ in range(r.randint(1, 4)))
        for y in (x, "".join(w[0] for w in x.split())):
            names.setdefault(y.lower(), y)
    entities, ids = [], []
    for name in names.values():
        k = next((i for i, e in enumerate(entities) if resolve.alias_step(e, name)), len(entities))
        entities += [resolve.Entity(name)] * (k == len(entities))
        ids.append(k)
    assert resolve.fold_names(iter(names.values())) == (ids, entities)


def test_merge_and_empty_names():
    a, b = resolve.Entity("Acme Co."), resolve.Entity("Acme", ["Acme", "ACME"])
    assert resolve.merge(a, b) and a.aliases == ["Acme Co.", "Acme", "ACME"]
    assert not resolve.alias_step(resolve.Entity("."), "Acme")
    assert resolve.alias_step(resolve.Entity("."), ".") in (True, False)


def test_markup_and_chains(spark):
    docs = annotated.parse_markup(fixtures.MARKUP)
    assert [len(s) for s in docs[0][1]] == [7, 8]
    assert [e[1:] for e in docs[0][2]] == [(0, 0, 3), (0, 4, 6), (1, 2, 3)]
    files = spark.createDataFrame([("a", fixtures.MARKUP), ("b", "<ROOT><DOC>x"), ("c", None)], "path string, content string")
    parsed = annotated.parse_documents(files).collect()
    assert [r["doc"] for r in parsed if not r["error"]] == ["D1", "D2"] and sum(bool(r["error"]) for r in parsed) == 2
    chains = annotated.read_chains(spark.createDataFrame([("p", fixtures.CHAINS)], "path string, content string"))
    got = spans.expand_coreferences(annotated.parse_documents(files), chains).orderBy("doc", "seq").collect()
    assert [(r["sent"], r["surface"]) for r in got if r["doc"] == "D1"] == [(0, "Acme Co ."), (0, "Bolt Inc."), (1, "Bolt's"), (1, "Acme Co ."), (1, "Acme Co .")]
    bad = annotated.read_chains(spark.createDataFrame([("p", "(\nD\n(\n(\n")], "path string, content string")).collect()
    assert bad[0]["error"]


def test_repair():
    clean = {k: sanitize.repair(v) for k, v in fixtures.BROKEN.items()}
    assert clean["fragments"] == ("<ROOT><DOC>a</DOC><DOC>b</DOC>\n</ROOT>\n", "clean", ["FRAGMENTS"])
    assert clean["and"][0] == "<ROOT><DOC>AT&amp;T and R &amp; D &amp; x</DOC></ROOT>\n"
    assert clean["mismatch"][0] == '<ROOT><DOC><ENAMEX TYPE="X">a</ENAMEX></DOC></ROOT>\n'
    assert clean["cut"][0] == "<ROOT><DOC>a</DOC></ROOT>\n"
    assert clean["several"][1] == "clean" and clean["clean"][2] == [] and clean["hopeless"][1] == "unfixable"


def test_names_and_markup_come_from_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    names = {n.lower() for n in fixtures.NAMES} | {r[0].lower() for t, c in (("customer", "c_name"), ("part", "p_name")) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c).collect()}
    got = queries.QUERIES["alias_resolution"](spark, sf).toPandas()
    assert set(got.surface_lc) == names and len(got) == len(names)
    made = queries.QUERIES["entity_dimension"](spark, sf).toPandas()
    assert names == {a.lower() for aliases in made.aliases for a in aliases} and set(made.key) == set(got.key)
    paths = {f"page {r[0]}" for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id").collect()} | set(fixtures.BROKEN)
    for name in ("wellformedness", "repair"):
        assert {r["path"] for r in queries.QUERIES[name](spark, sf).select("path").collect()} == paths


def test_broken_documents_leave_the_others(spark):
    corp = '<ENAMEX TYPE="ORGANIZATION:CORPORATION">%s</%s>'

    def doc(name, close="ENAMEX", end=" met .\n</DOC>"):
        return f"<DOC><DOCNO> {name} </DOCNO>\n{corp % ('Acme Co .', close)} and {corp % ('Bolt Inc.', 'ENAMEX')}{end}"

    many = "".join(doc(f"m{k}", "NUMEX") for k in range(150))
    files = {
        "mismatches": f"<ROOT>{many}</ROOT>\n",
        "line_end": f"<ROOT>{doc('e1')}{doc('e2', end=' met .</DOC>')}{doc('e3')}</ROOT>\n",
        "open": f"<ROOT>{doc('o1')}{doc('o2').replace('</ENAMEX>', '', 1)}{doc('o3', 'NUMEX')}</ROOT>\n",
        "hopeless": f"<ROOT>{doc('h1')}<DOC a=>x</DOC>{doc('h3')}</ROOT>\n",
        "outside": f"<ROOT>{doc('x1')}</ROOT>\n",
    }
    files["outside"] = files["outside"].replace("<ROOT>", "<ROOT>stray", 1)
    assert sanitize.repair(files["mismatches"])[1:] == ("clean", ["TAG_MISMATCH"])
    assert sanitize.fix_tag_mismatch("<a><!-- </b> --><b></c></a>") == "<a><!-- </b> --><b></b></a>"
    table = spark.createDataFrame(list(files.items()), "path string, content string")
    found, _, failed = lifecycle.mentions_from_text(table, spark.createDataFrame([("p", fixtures.CHAINS), ("q", ")")], "path string, content string"))
    good = {f"m{k}" for k in range(150)} | {"e1", "e3", "o1", "o3", "h1", "h3", "x1"}
    parsed = annotated.parse_documents(sanitize.repair_markup(table)).where("error is null").collect()
    assert {r["doc"] for r in parsed} == good and all(len(r["entities"]) == 2 for r in parsed)
    assert {(r["path"], r["doc"]) for r in failed.collect()} == {("line_end", "e2"), ("open", "o2"), ("hopeless", None), ("outside", None), (None, None)}
    # only documents that the coreference files name have mentions
    named = spark.createDataFrame([("p", "".join(f"(\n{d}\n)\n" for d in sorted(good)))], "path string, content string")
    assert {r["doc"] for r in lifecycle.mentions_from_text(table, named)[0].select("doc").distinct().collect()} == good


def test_louvain_splits_a_dumbbell(spark):
    left = [(a, b, 1.0) for a, b in ((1, 2), (1, 3), (2, 3))]
    right = [(a, b, 1.0) for a, b in ((4, 5), (4, 6), (5, 6))]
    edges = spark.createDataFrame([*left, *right, (3, 4, 0.1)], "a long, b long, weight double")
    nodes = graph.connected_components(edges)
    assert nodes.select("component").distinct().count() == 1
    member = {r["id"]: r["community"] for r in graph.louvain(nodes, edges).collect()}
    assert member == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 200)], "a long, b long")
    assert [r["component"] for r in graph.connected_components(edges).select("component").distinct().collect()] == [0]


def test_statistics(spark):
    tables = {k: {r[0]: r["n"] for r in v.collect()} for k, v in lifecycle.statistics(edges_of(spark)).items()}
    assert tables["documents"]["1"] == 3 and tables["documents"]["2"] == 1 and tables["documents"]["6+"] == 0
    assert sum(tables["weights"].values()) == 4
    # hand-made: the weights 0.18, 0.18, 0.68 and 1 in ceil(log2(4) + 1) = 3 cells, so of width 0.2
    assert [tuple(r) for r in lifecycle.statistics(edges_of(spark))["weights"].orderBy("bin").collect()] == [(0, 0.0, 0.2, 2), (3, 0.6, 0.8, 1), (4, 0.8, 1.0, 1)]
    for args, want in (((100, 0.0, 1.0), (0.1, 0, 10)), ((100, -0.31, 0.99), (0.2, -2, 5)), ((1000, 3.0, 90.0), (10.0, 0, 9)), ((1, 5.0, 5.0), (1.0, 5, 5))):
        got = report.sturges_breaks(*args)
        assert math.isclose(got[0], want[0]) and got[1:] == want[1:]


def test_coreference_files_need_no_lines_of_their_own_for_parentheses():
    text = "( D1 ( Antecedent -> S1:1-2 -> Acme (US)\nPronoun -> S2:1-1 -> It )\n( Antecedent -> S1:1-1 -> Bolt\n\n) )(\nD 2\n)\n(D3(Pronoun -> S1:1-1 -> He))"
    assert list(annotated.parse_chains(text)) == [
        ("D1", 0, "Antecedent", "S1:1-2", "Acme (US)"), ("D1", 0, "Pronoun", "S2:1-1", "It"), ("D1", 1, "Antecedent", "S1:1-1", "Bolt"),
        ("D 2", None, None, None, None), ("D3", 0, "Pronoun", "S1:1-1", "He"),
    ]
    for bad in ("(D1", ")", "( D1 ( ( x", "( D1 ( no entry\n) )", "x"):
        with pytest.raises(ValueError):
            list(annotated.parse_chains(bad))


def test_louvain_gains_modularity_over_components(spark):
    """Two cliques with a bridge, and a ring of cliques: the communities are the cliques, and their modularity beats that of one community a component."""
    pairs = [(10 * c + i, 10 * c + j) for c in range(6) for i in range(5) for j in range(i)] + [(10 * c, 10 * ((c + 1) % 6) + 1) for c in range(6)]
    edges = spark.createDataFrame([(min(p), max(p), 1.0) for p in pairs], "a long, b long, weight double")
    nodes = graph.drop_small(graph.connected_components(edges))
    got = graph.louvain(nodes, edges, 1.0)
    member = {r["id"]: r["community"] for r in got.collect()}
    assert {v: 10 * (v // 10) for v in member} == member and report.community_count(got).first()[0] == 6

    def modularity(of):
        degree = {}
        for a, b in pairs:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        inside = sum(of[a] == of[b] for a, b in pairs) / len(pairs)
        return inside - sum((sum(d for v, d in degree.items() if of[v] == c) / (2 * len(pairs))) ** 2 for c in set(of.values()))

    assert modularity(member) > modularity(dict.fromkeys(member, 0)) + 0.5


def test_files_and_cache(spark, tmp_path):
    e = edges_of(spark)
    back = networks.read_network(spark, networks.write_network(e, str(tmp_path / "n"))).toPandas()
    pd.testing.assert_frame_equal(back.sort_values(["a", "b"]).reset_index(drop=True), e.select("a", "b", "npmi", "sentences", "documents").toPandas().sort_values(["a", "b"]).reset_index(drop=True))
    path, built = str(tmp_path / "c"), []
    for refresh in (False, False, True):
        networks.cached(spark, path, lambda: built.append(1) or spark.range(3).toDF("x"), refresh)
    assert len(built) == 2
    assert networks.gexf([(1, "a<b")], [(1, 2, 0.5)]).count("<node ") == 1


def test_missing_alias_is_an_error(spark):
    m = spark.createDataFrame([("d", 0, "x")], "doc string, sent int, ent string")
    with pytest.raises(Exception, match="Missing aliases"):
        mentions.resolve_keys(m, spark.createDataFrame([], "key string, aliases array<string>")).collect()


def test_command_line(spark, tmp_path, capsys):
    from quillnet.__main__ import main

    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "a.txt").write_text(fixtures.MARKUP)
    (corpus / "a.pron").write_text(fixtures.CHAINS)
    (corpus / "b.txt").write_text("<ROOT><DOC><DOCNO> D9 </DOCNO>no line end</DOC></ROOT>")
    assert main(["network", str(corpus), str(tmp_path / "out")], spark) == 1 and "D9" in capsys.readouterr().err
    edges = networks.read_network(spark, str(tmp_path / "out/network"))
    assert edges.count() >= 3
    assert main(["clusters", str(tmp_path / "out/network"), str(tmp_path / "out")], spark) == 0
    assert main(["statistics", str(tmp_path / "out/network")], spark) == 0
    assert "# documents\nbucket,n\n1," in capsys.readouterr().out


def test_tables_are_dropped(spark):
    zero, since = graph._table(spark.range(2), "zero"), graph.written(spark)
    one, two = graph._table(spark.range(3), "one"), graph._table(spark.range(4), "two")
    graph.drop_tables(spark, two, since)
    assert two.count() == 4 and zero.count() == 2 and graph.written(spark) == since + 1
    with pytest.raises(Exception, match="(?i)not.*exist|no such file"):
        one.count()


def test_expansion_keeps_chains_apart_where_ids_repeat(spark):
    # two antecedents with one id; only that of chain 0 meets the entity
    columns = "doc long, chain long, id long, from int, to int"
    antecedents = spark.createDataFrame([(1, 0, 61, 0, 2), (1, 1, 61, 9, 11)], columns)
    entities = spark.createDataFrame([(1, None, 7, 1, 3)], columns)
    pronouns = spark.createDataFrame([(1, 0, 20, 5, 6), (1, 1, 30, 12, 13)], columns)
    assert [tuple(r) for r in spans.expand(antecedents, entities, pronouns).collect()] == [(1, 0, 7, 20)]


def test_valid_entries_meet_every_span_at_their_range(spark, tmp_path):
    # in a turn of three words the first and the last span are one range
    turns = spark.createDataFrame([(1, 1, "user", "a b c"), (1, 2, "user", "d e f g h")], "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = queries.QUERIES["valid_entries"](spark, str(tmp_path)).toPandas()
    assert len(got) == 5
    assert rows(got) == rows(con.sql(queries.SQL["valid_entries"]).df())


def test_fold_tries_only_names_that_may_fit(monkeypatch):
    # names of one length whose digits are dealt differently never fit
    names = [f"Customer#{k:09d}" for k in range(3000)]
    tried = []
    step = resolve.alias_step
    monkeypatch.setattr(resolve, "alias_step", lambda e, name: tried.append(name) or step(e, name))
    assert resolve.fold_names(iter(names))[0] == list(range(3000))
    assert len(tried) < 3000


@pytest.mark.parametrize("seed", range(60))
def test_fold_equals_trying_all_entities(seed):
    r = random.Random(seed)
    words = ["Acme Bolt of and The the Co. Inc. International Business Machines IBM A&P Time-Warner . & 's Sachs U.S. PLC a I.B.M. Σας ΣΑΣ İstanbul".split(), "a b A B ab aB Ab AB .a a. A. aBc AbC abc . .. the - / & '".split()][seed % 2]
    names = {}
    for _ in range(r.randint(5, 80)):
        x = r.choice([" ", "", "  "]).join(r.choice(words) for _ in range(r.randint(1, 5)))
        for y in (x, "".join(w[:1] for w in x.split(" ")), ".".join(w[:1] for w in x.split(" ")) + "."):
            names.setdefault(y.lower(), y)
    ids, entities = [], []
    for name in names.values():
        k = next((i for i, e in enumerate(entities) if resolve.alias_step(e, name)), len(entities))
        entities += [resolve.Entity(name)] * (k == len(entities))
        ids.append(k)
    assert resolve.fold_names(iter(names.values())) == (ids, entities)


def test_folds_of_parted_names_equal_one_fold(spark, monkeypatch):
    r = random.Random(5)
    words = "Acme Bolt of and The the Co. Inc. International Business Machines IBM A&P Time-Warner . & 's Sachs U.S. PLC a I.B.M. Σας İstanbul".split()
    names = {f"x{k}": f"Nobody#{k:05d}" for k in range(150)}
    for _ in range(150):
        x = r.choice([" ", "", "  "]).join(r.choice(words) for _ in range(r.randint(1, 5)))
        for y in (x, "".join(w[:1] for w in x.split(" ")), ".".join(w[:1] for w in x.split(" ")) + ".", f"{x} {r.randint(1, 999)}"):
            names.setdefault(y, y)
    seen = spark.createDataFrame([(x, r.random()) for x in names.values()], "surface string, ord double")
    want = resolve.resolve_surfaces(seen).toPandas()
    monkeypatch.setattr(resolve, "AT_ONCE", 0)
    monkeypatch.setattr(resolve, "RANGE", 9)
    got = resolve.resolve_surfaces(seen)
    assert rows(got.toPandas()) == rows(want)
    assert len(set(want.entity_id)) < len(want) - 20


def test_communities_use_all_tasks_and_are_found_once(spark):
    made = spark.createDataFrame([(10 * k + a, 10 * k + b, 0.9, 3, 1) for k in range(40) for a, b in ((0, 1), (0, 2), (1, 2))], "a long, b long, npmi double, sentences long, documents long")
    got = graph.louvain(*graph.filtered_graph(made))
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r["id"]: r["community"] for r in got.collect()} == {10 * k + a: 10 * k for k in range(40) for a in range(3)}
    plan = lifecycle.build_clusters(made)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan
