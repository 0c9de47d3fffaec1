"""Findings of long answers: read in their own row, both kinds in turn, each capped."""

from colloquy.sources.payloads import MARKDOWN_CAP, markdown_findings


def test_capped_kinds_in_turn_without_a_shuffle(spark):
    fix, doubt = '- [0:05] "a{}" => "b"', '* 00:12:30 "d{}" (raison : flou)'
    one = ["# Doutes", fix.format(0), " " + doubt.format(0), "# Titre", doubt.format(1), "# CORRECTIONS"]
    one += [fix.format(i) for i in range(30)] + ["sans"] + ["# uncertain"] + [doubt.format(i) for i in range(2, 40)] + ["# Correction", fix.format(99)]
    rows = spark.createDataFrame([(1, "\r\n".join(one)), (2, fix.format(0)), (3, None), (4, "Aucune correction\nAucun doute\n# Corrections\n" + fix.format(0)), (5, "")], "id long, text string")
    out = markdown_findings(rows)
    got = {(r.id, r.kind, r.n): r.original for r in out.collect()}
    # A line with a second quote is a doubt as well: what follows the first quote is not looked at.
    doubts = ["a0", "d0", "d1", *(f"d{i}" for i in range(2, 40))][:MARKDOWN_CAP]
    want = {(1, "correction", n): f"a{n - 1}" for n in range(1, MARKDOWN_CAP + 1)} | {(1, "doubt", n): d for n, d in enumerate(doubts, 1)}
    assert got == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
