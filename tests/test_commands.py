import pytest

from weirflow import operators as O
from weirflow.builder import Pipeline, RecordError
from weirflow.functions.literals import LiteralError, parse, show
from weirflow.functions.patterns import translate
from weirflow.plans.command import register_op, run

VECTORS = [
    ("seq=10 sum", "45"), ("v=17 ,v=42", "17 42"), ("seq=3 fe sum", "3"), ("seq=3 fe: sum end", "0 1 2"), ("seq=10 chunks=3: sum end", "3 12 21 9"),
    ("seq=10 chunks: 3 sum end", "3 12 21 9"), ("seq=3 fe: dup=2 join=, end", "0,0 1,1 2,2"), ("seq=6 r=[135]", "1 3 5"),
    ("str=a fc: nop next f='{}!' end", "a a!"), ("str='aba34jf baacdaab' r-o='a.{2}'", "aba a34 aac acd aab"), ("seq=5 c='_*2+1'", "1 3 5 7 9"),
    ("primes head=4", "2 3 5 7"), ("seq=10 tail=+7", "7 8 9"), ("seq=10 head=-8", "0 1"), ("seqn=4 avg", "2.5"), ("seq=5 max", "4"),
    ("seq=4 fe: r=2 count end", "0 0 1 0"), ("v='[1,2,3]' flatten", "1 2 3"), ("str=abc chars join=-", "a-b-c"), ("seq=3 typename", "int int int"),
    ("v='{a: 3, b: \"5\"}' explode f='{a}{b}'", "35"), ("str=q7 r='(?<x_y>[a-z])(?<n>\\d)' f='{n}{x_y}'", "7q"), ("seq=3 enumn", "1 2 3"),
    ("seq=3 py='_+1'", "1 2 3"), ("f='{%bs}'", "1024"), ("seq=2 fe: seq=3 enum=2 end", "0 1 0 1"), ("macro: two seq=2 end two sum", "1"),
    ("seq=5 c='_>2' filter count", "2"), ("seq=-1,-5,-2", "-1 -3"), ("seq=3 fe: forkcat: seq=2 next nop end end", "0 1 0 0 1 1 0 1 2"),
    ("tl seqn=10 forkcat: r=.* next drop end count", "10"), ("%bs=42 f={%bs}", "42"), ("v='\"x\\ty\"' f='{:?}'", '"x\\ty"')
]


@pytest.mark.parametrize("command, want", VECTORS)
def test_vectors(spark, command, want):
    got = run(spark, command).strings()
    assert got == want.split(" ")


MORE = [
    ("seq=7 aggregate: head=3 next sum end", ["0", "1", "2", "18"]), ("seq=2 aggregate: head=3 next count end", ["0", "1", "1"]),
    ("seq=2 fe: aggregate: nop next str=x end end", ["0", "x", "1", "x"]), ("seq=6 aggregate: enum=2 next head=1 next count end", ["0", "1", "2", "3"]),
    ("seq=2 fe: seq=4 chunks=2: forkcat: nop next str=x end end end", "0 1 x x 2 3 x x 0 1 x x 2 3 x x".split()),
    ("v=9223372036854775807 dup=5 sum", [str(5 * (2**63 - 1))]), ("v=inf dup=2 sum", ["inf"]), ("v=3e-15 dup=2 sum", ["6.0E-15"]),
    ("v=4e300 dup=2 sum", ["8.0E300"]), ("fc: v=inf next v=-inf end sum", ["nan"]), ("v=9223372036854775807 c='_*_'", [str((2**63 - 1) ** 2)]),
    ("v=99999999999999999999999999999999999999 c='_+1'", ["ERROR: integer of more than 38 digits"]), ("v=7 c='_**40'", [str(7**40)]),
    ("v='[4, \"q\", 1.5, null]' flatten c='_+1' ee max", ["5"]), ("v='[4, \"q\", 1.5, null, true]' flatten typename", "int str float null bool".split()),
    ("v='[2,0.25]' flatten sum", ["2.25"]), ("v='{p: {q: 6}}' c='_.p.q * 7'", ["42"]), ("v='{p: 1}' c='_.z'", ["null"]),
    ("seq=2 c='[_, [7, \"z\"]]' flatten", ["0", '[7, "z"]', "1", '[7, "z"]']), ("v='{k: 8, j: \"b\"}' flatten f='{:?}'", ['["k", 8]', '["j", "b"]']),
    ("str=bcd r='(?<x>a*)(b|c)' f='<{x}>'", ["<>"]), ("str=bcd r='(?<x>a)?(b|c)' f='<{x:?}>'", ["<null>"]), ("str=aab r-m='(?<x>a)?(?<y>b)?' f='{x:?}{y:?}'", ['"a"null', '"a""b"', "nullnull"]),
    ("seq=7 [ join . -n=3 ]", ["0.1.2", "3.4.5", "6"]), ("seq=7 join -n=3 -d", ["012", "345"]), ("seq=0 [ join . -n=3 ]", []),
    ("primes c='_*2' head=3", ["4", "6", "10"]), ("v=1500 f='{:e}|{:#x}|{:b}'", ["1.5e3|0x5dc|10111011100"]), ("v=0.00123 f='{:E}'", ["1.23E-3"]),
    ("v=2 key=p v=3.14159 f='{:.p$}'", ["3.14"]), ("v='{a: [1,2]}' f='{:##?}'", ["{a:[1,2]}"]), ("[ atom town Oslo ] f='{%town}'", ["Oslo"]),
    ("fc: v=1 next str=a next v=2.5 end c='_+1' f='{:?}'", ["2", '(error)"invalid operands for binary op: `str` + `int`"', "3.5"]),
    ("macro:=triple v=\"[['dup', 3], ['join']]\" end str=ab triple", ["ababab"]), ("str='<p>a<b id=\"k\">c</b><br>d</p>' xpath=//b/@id", ["k"]),
    ("str='<p>a<b>c</b>d</p>' xpath=//p/text()", ["ad"]), ("v=9007199254740993 c='_ == 9007199254740992.0'", ["false"]),
]


@pytest.mark.parametrize("command, want", MORE)
def test_more_vectors(spark, command, want):
    assert run(spark, command).strings() == want


def test_sums_do_not_depend_on_order_or_partitions(spark):
    from fractions import Fraction

    values = [(-1) ** k * 1.1 ** (k * 37 % 1400 - 700) for k in range(3000)] + [0.1] * 50
    want = float(sum(map(Fraction, values)))
    got = set()
    for n in (1, 5):
        df = spark.createDataFrame(list(enumerate(values)), "id long, v double").repartition(n)
        got.add(Pipeline.from_dataframe(df, "id", "v").sum().collect()[0])
    assert len(got) == 1 and abs(got.pop() - want) <= abs(want) * 1e-15


def test_sources_keep_order_without_one_partition(spark, tmp_path):
    text = "\n".join(f"line {k}" for k in range(5000))
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("last\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        p = Pipeline.text_lines(spark, str(tmp_path))
        assert p.stream.df.rdd.getNumPartitions() > 4
        assert p.strings() == [*text.split("\n"), "last"]
        assert "SinglePartition" not in p.stream.df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "q.csv").write_text('k,v\n1,"two\nlines"\n2,"a ""b"", c"\n')
    assert [tuple(r) for r in Pipeline.csv(spark, str(tmp_path / "q.csv"), header=True).to_dataframe().select("k", "v").collect()] == [(1, "two\nlines"), (2, 'a "b", c')]
    (tmp_path / "m.jsonl").write_text('"x"\n7\n{\n\n[1, "z"]\n')
    assert Pipeline.jsonl(spark, str(tmp_path / "m.jsonl")).strings() == ["x", "7", "ERROR: invalid JSON: {", '[1, "z"]']


def test_print_fork_and_stdin(spark, tmp_path, capsys):
    from weirflow.plans.command import run_fork

    assert run(spark, "seq=3 print").strings() == ["null"] * 3 and capsys.readouterr().out == "0\n1\n2\n"
    assert [p.strings() for p in run_fork(spark, "seq=4 fork: sum next count end")] == [["6"], ["4"]]
    assert Pipeline.stdin(spark, "a\nb\n").lines().strings() == ["a", "b"]
    with pytest.raises(ValueError):
        run(spark, "fork: nop end sum")


def test_empty_matches_and_padding(spark):
    assert run(spark, "str=babab r-m='a*'").strings() == ["", "a", "", "a", "", ""]
    assert run(spark, "str=foo r-o='o*'").strings() == ["", "oo", "o", ""]
    assert run(spark, "str=x key=foo seq=6 key=bar f='{foo:~^bar$}'").strings() == ["x", "x", "~x", "~x~", "~~x~", "~~x~~"]
    assert run(spark, ["str=a\nb\n", "lines"]).strings() == ["a", "b"]
    assert run(spark, "seq=2 key=lbl fc: str=a next str=b end f='{lbl}: {}'").strings() == ["0: a", "1: a", "0: b", "1: b"]


def test_errors_are_values(spark):
    assert run(spark, "seq=3 c='10/_'").strings() == ["ERROR: Division by Zero", "10", "5"]
    assert run(spark, "seq=3 c='10/_' ee sum").strings() == ["15"]
    assert run(spark, "f='{}'").strings()[0].startswith("ERROR: unexpected type 'undefined'")
    assert run(spark, "seq=3 c='10/_' sum").strings() == ["ERROR: Division by Zero"]
    assert not run(spark, "error=x").succeeded() and run(spark, "v=1").succeeded()
    with pytest.raises(RecordError):
        run(spark, "str=x to_int").collect()


def test_empty_groups(spark):
    for op, want in ((O.count(), [0, 1]), (O.sum_(), [0, 1]), (O.join(","), ["", "1"]), (O.max_(), [1])):
        got = Pipeline(spark).seq(2).foreach(O.regex("1"), O.to_int_(), op)
        assert got.collect() == want


def test_partitions_change_nothing(spark):
    df = spark.range(500).selectExpr("id", "id % 7 as v")
    for n in (1, 3, 11):
        p = Pipeline.from_dataframe(df.repartition(n), "id", "v")
        assert p.chunks(9, O.tail(2), O.join("")).collect()[:3] == ["01", "23", "45"]
        assert p.enum().tail(2).collect() == [498, 499] and p.head(-497).collect() == [0, 1, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'name,age,job\r\nann,31,"x, ""y"""\r\nbob,4\r\ncy,7,q,extra\r\n')
    p = Pipeline.csv(spark, str(tmp_path / "a.csv"), header=True)
    assert [tuple(r) for r in p.to_dataframe().select("name", "age", "job").collect()] == [("ann", 31, 'x, "y"'), ("bob", 4, None), ("cy", 7, "q")]
    assert p.select("age").max().format("{name}: {age}").strings() == ["ann: 31"]
    (tmp_path / "b.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert [tuple(r) for r in Pipeline.jsonl(spark, str(tmp_path / "b.jsonl")).to_dataframe().select("a", "b").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "c.txt").write_text("one\ntwo\n")
    assert run(spark, f"file={tmp_path}/c.txt lines").strings() == ["one", "two"]
    run(spark, f"file={tmp_path}/c.txt lines").write(str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_languages():
    assert parse("{a: 1, b: [1.5, 'x', null, true], 'c d': b'q'}") == {"a": 1, "b": [1.5, "x", None, True], "c d": b"q"}
    assert show({"a": [1, "x\n", None], "b c": 1.5}) == '{a: [1, "x\\n", null], "b c": 1.5}'
    for bad in ("", "[1", "{a 1}", "1 2", "zz"):
        with pytest.raises(LiteralError):
            parse(bad)
    assert translate("(?<a_b>x)(y)?$").groups == ("a_b", "2") and translate("a$").java.endswith("a\\z")
    for bad in ("(?=a)", "(a)\\1"):
        with pytest.raises(ValueError):
            translate(bad)


def test_plugins_and_refusals(spark):
    register_op("shout", lambda call: O.chain(O.compute("upper(_)"), O.format_("{}!")))
    assert run(spark, "str=a shout").strings() == ["A!"]
    for bad in ("nope=1", "exec=ls", "primes sum", "seq=3 end"):
        with pytest.raises(ValueError):
            run(spark, bad)


def test_streaming(spark, tmp_path):
    from weirflow.streaming import on_stream

    spark.range(20).selectExpr("id", "concat('k', id) as v").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in"))
    q = on_stream(src, "id", "v", O.regex("[13579]$"), O.to_int_(), O.compute("_ * 2")).writeStream.format("memory").queryName("odd").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.sql("select value from odd").collect()) == sorted(2 * (i % 10) for i in range(20) if i % 2)


def test_labelled_chains_and_sessions(spark):
    from weirflow.plans.command import Session

    p = Pipeline(spark).define("twice", O.compute("_ * 2"), O.sum_()).seq(4)
    assert p.call("twice").collect() == [12]
    with pytest.raises(ValueError):
        p.call("nowhere")
    s = Session(spark)
    assert s.run("seq=4").strings() == ["0", "1", "2", "3"] and s.run("_ sum").strings() == ["6"] and s.run("_ f='{}!'").strings() == ["6!"]
