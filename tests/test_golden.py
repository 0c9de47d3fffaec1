"""Golden cases and brute-force twins for what SQL does not say well."""

import math
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import clock as C
from colloquy.functions import rewrite as R
from colloquy.functions import text as T
from colloquy.functions.phonetic import phonetic_key
from colloquy.operators import aggregates, chunks, corrections, glossary, joins, mining, ordered, sequences, speakers


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def turns_df(spark, rows, schema="job_id long, seq long, start_ms long, end_ms long, speaker string"):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ scan

@pytest.mark.parametrize("block", [1, 3, 1000])
def test_scan_is_a_window_over_the_whole_key(spark, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = [(j, s, rng.choice([None, 1, 2, 3])) for j in (1, 2) for s in range(40) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "job_id long, seq long, v long")
    v = F.col("v")
    out = ordered.scan(df, [ordered.Step(k, k, v) for k in ("lag", "lead", "sum", "sum_before", "last", "last_before", "next", "max_before")])
    got = {(r.job_id, r.seq): r.asDict() for r in out.collect()}
    for j in (1, 2):
        seqs = sorted((s, x) for jj, s, x in rows if jj == j)
        for i, (s, x) in enumerate(seqs):
            before, after = [y for _, y in seqs[:i]], [y for _, y in seqs[i + 1:]]
            known = lambda ys: [y for y in ys if y is not None]
            want = {
                "lag": before[-1] if before else None, "lead": after[0] if after else None,
                "sum": sum(known(before + [x])), "sum_before": sum(known(before)),
                "last": (known(before + [x]) or [None])[-1], "last_before": (known(before) or [None])[-1],
                "next": (known(after) or [None])[0], "max_before": max(known(before), default=None),
            }
            assert {k: got[j, s][k] for k in want} == want


# ------------------------------------------------------------------ folds

def brute_micro(items, least=400, gap=1000):
    items = [list(t) for t in items]
    for phase in (1, 2):
        i = 0
        while i < len(items):
            s, e, who = items[i]
            if e - s >= least or (phase == 2 and len(items) == 1):
                i += 1
                continue
            if phase == 1:
                if i and items[i - 1][2] == who and s - items[i - 1][1] <= gap:
                    items[i - 1][1] = max(items[i - 1][1], e)
                elif i + 1 < len(items) and items[i + 1][2] == who and items[i + 1][0] - e <= gap:
                    items[i + 1][0] = min(items[i + 1][0], s)
                else:
                    i += 1
                    continue
            else:
                left = s - items[i - 1][1] if i else math.inf
                right = items[i + 1][0] - e if i + 1 < len(items) else math.inf
                if left <= right:
                    items[i - 1][1] = max(items[i - 1][1], e)
                else:
                    items[i + 1][0] = min(items[i + 1][0], s)
            items.pop(i)
    out = items[:1]
    for t in items[1:]:
        if t[2] == out[-1][2] and t[0] - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], t[1])
        else:
            out.append(t)
    return [tuple(t) for t in out]


def random_timeline(rng, n, short=0.5):
    at, out = 0, []
    for _ in range(n):
        at += rng.choice([0, 100, 600, 1500, 3000])
        d = rng.choice([100, 250, 390]) if rng.random() < short else rng.choice([400, 900, 3000])
        out.append((at, at + d, rng.choice("ABC")))
        at += d if rng.random() < 0.8 else d // 2
    return sorted(out)


def test_micro_turns(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    jobs = {j: random_timeline(rng, rng.randint(1, 40), rng.random()) for j in range(60)}
    df = turns_df(spark, [(j, i, s, e, w) for j, ts in jobs.items() for i, (s, e, w) in enumerate(ts)])
    got = {}
    for r in sequences.fuse_micro_turns(df).orderBy("job_id", "seq").collect():
        got.setdefault(r.job_id, []).append((r.start_ms, r.end_ms, r.speaker))
    assert got == {j: brute_micro(ts) for j, ts in jobs.items()}


def fused_rows(spark, jobs):
    df = turns_df(spark, [(j, i, s, e, w) for j, ts in jobs.items() for i, (s, e, w) in enumerate(ts)])
    got = {}
    for r in sequences.fuse_micro_turns(df).orderBy("job_id", "seq").collect():
        got.setdefault(r.job_id, []).append((r.start_ms, r.end_ms, r.speaker))
    return got


@pytest.mark.parametrize("rows", [2, 5])
def test_micro_turns_across_blocks(spark, monkeypatch, rows):
    """States that cross several blocks: one voice, short turns inside very long ones, equal starts, no speaker."""
    monkeypatch.setattr(sequences, "FOLD_ROWS", rows)
    rng = random.Random(rows)
    jobs = {j: random_timeline(rng, rng.randint(1, 40), rng.random()) for j in range(30)}
    jobs |= {j: [(s, e, rng.choice(["A", None])) for s, e, _ in random_timeline(rng, 30, 1.0)] for j in range(30, 40)}
    jobs |= {j: sorted([(0, 20_000, "A")] + [(s, s + rng.choice([0, 50, 399]), rng.choice("AB")) for s in rng.choices(range(25_000), k=50)], key=lambda t: t[0]) for j in range(40, 50)}
    jobs |= {50: [(0, 10, "A")], 51: [(5, 5, "A"), (5, 5, "B"), (5, 5, "A")], 52: [(100, 200, "A")] * 12}
    assert fused_rows(spark, jobs) == {j: brute_micro(ts) for j, ts in jobs.items()}


@pytest.mark.parametrize("voices", ["A", "ABC"])
def test_micro_turns_of_one_long_flicker(spark, voices):
    """No long turn parts the run, and no row may hold more than a block of it."""
    rng = random.Random(9)
    at, rows = 0, []
    for _ in range(100_000):
        rows.append((at, at + rng.randint(0, 399), rng.choice(voices)))
        at = rows[-1][1] + rng.choice([0, 100, 900, 1500])
    assert fused_rows(spark, {1: rows}) == {1: brute_micro(rows)}


def brute_orphans(rows):
    out = []
    for i, (s, e, who) in enumerate(rows):
        if who is None and e - s <= 600:
            prev = out[-1] if out else None
            nxt = rows[i + 1] if i + 1 < len(rows) else None
            p, n = prev and prev[2], nxt and nxt[2]
            gp = s - prev[1] if prev else math.inf
            gn = nxt[0] - e if nxt else math.inf
            if p and n:
                who = p if p == n else n if gn <= gp else p
            elif n and gn <= 2000:
                who = n
            elif p and gp <= 2000:
                who = p
        out.append((s, e, who))
    return [o[2] for o in out]


def test_orphans(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 5)
    rng = random.Random(8)
    jobs = {}
    for j in range(80):
        jobs[j] = [(s, e, None if rng.random() < 0.6 else w) for s, e, w in random_timeline(rng, 30, 0.7)]
    df = turns_df(spark, [(j, i, s, e, w) for j, ts in jobs.items() for i, (s, e, w) in enumerate(ts)])
    got = {}
    for r in sequences.absorb_orphans(df).orderBy("job_id", "seq").collect():
        got.setdefault(r.job_id, []).append(r.speaker)
    assert got == {j: brute_orphans(ts) for j, ts in jobs.items()}


def brute_paragraphs(rows):
    """rows: (start, end, speaker, text) of one job."""
    out, prev = [], None
    for s, e, who, text in rows:
        if prev is None or prev[0] != who or s - prev[1] >= 1200 or s - out[-1][1] >= 25_000:
            out.append([who, s, e, 1, [text]])
        else:
            out[-1][2] = e
            out[-1][3] += 1
            out[-1][4].append(text)
        prev = (who, e)
    return [(who, s, e, n, " ".join(t).strip()) for who, s, e, n, t in out]


def paragraph_rows(spark, jobs):
    df = turns_df(spark, [(j, i, *r) for j, rows in jobs.items() for i, r in enumerate(rows)], "job_id long, seq long, start_ms long, end_ms long, speaker string, text string")
    got = {}
    for r in sequences.paragraphs(df).orderBy("job_id", "seq").collect():
        got.setdefault(r.job_id, []).append((r.speaker, r.start_ms, r.end_ms, r.n, r.text))
    return got


@pytest.mark.parametrize("most", [1024, 9])
def test_paragraphs(spark, monkeypatch, most):
    """Short stretches as arrays, long ones by pointers; starts that go back, and leaps over whole buckets."""
    monkeypatch.setattr(sequences, "STRETCH_ROWS", most)
    rng = random.Random(5)
    jobs = {}
    for j in range(12):
        at, rows = rng.choice([0, 7_000]), []
        for i in range(rng.choice([1, 30, 250])):
            at += rng.choice([0, 100, 1199, 1199, 1200, 2000, -6000] if j % 2 else [0, 100, 300, 1100])
            d = rng.choice([0, 3000, 9000, 60_000] if j % 3 == 0 else [1, 3000, 9000])
            rows.append((max(at, 0), max(at, 0) + d, rng.choice("AAAAAAAB" if j % 4 else "A"), f"t{i}"))
            at = max(at, 0) + d
        jobs[j] = rows
    assert paragraph_rows(spark, jobs) == {j: brute_paragraphs(r) for j, r in jobs.items()}


def test_paragraphs_of_one_long_monologue(spark):
    rng = random.Random(8)
    at, rows = 0, []
    for i in range(100_000):
        rows.append((at, at + rng.randint(400, 4000), "A", f"w{i}"))
        at = rows[-1][1] + rng.randint(0, 1100)
    assert paragraph_rows(spark, {1: rows}) == {1: brute_paragraphs(rows)}


def test_text_chunks(spark):
    from colloquy.operators import chunks

    line = lambda c, n: c * n + "\n"
    rows = [
        ("short", "abc"), ("empty", ""), ("null", None), ("exact", "x" * 100),
        ("solid", "y" * 250),  # no line to cut at: full windows, 20 shared
        ("lines", line("a", 39) + line("b", 39) + line("c", 39) + line("d", 39)),  # cut before the newline past the half
        ("steps", line("g", 9) * 30),  # the next window opens on a line start within the overlap
        ("early", line("e", 10) + "f" * 150),  # a newline before the half is no cut
    ]
    want = {
        "short": ["abc"], "empty": [""], "null": [""], "exact": ["x" * 100],
        "solid": ["y" * 100, "y" * 100, "y" * 90],
        "lines": [line("a", 39) + "b" * 39, line("b", 20) + "c" * 39, line("c", 20) + line("d", 39)],
        "steps": [(line("g", 9) * 10)[:-1]] * 3 + [line("g", 9) * 6],
        "early": [line("e", 10) + "f" * 89, "f" * 81],
    }
    got: dict[str, list[str]] = {}
    df = spark.createDataFrame(rows, "id string, text string")
    for r in chunks.text_chunks(df, ["id"], 100, 20).orderBy("id", "index").collect():
        got.setdefault(r.id, []).append(r.text)
        assert r.total == len(want[r.id])
    assert got == want
    with pytest.raises(ValueError):
        chunks.text_chunks(df, ["id"], 100, 100)


# ------------------------------------------------------------------ loops and words

def brute_collapse(text):
    words, bare = text.split(), ".,;:!?…\"'()«»"
    before = list(words)
    for _ in range(6):
        for n in range(1, 7):
            out, i, hit = [], 0, False
            while i < len(words):
                gram, k = words[i:i + n], 1
                while len(gram) == n and words[i + k * n:i + (k + 1) * n] == gram:
                    k += 1
                if k >= 4 and any(w.strip(bare) for w in gram):
                    out += gram + ["…"]
                    i += k * n
                    hit = True
                else:
                    out.append(words[i])
                    i += 1
            if hit:
                words = out
                break
        else:
            break
    return text if words == before else " ".join(words)


def test_collapse_loops(spark):
    rng = random.Random(2)
    texts = ["de la Fondation " * 9 + "fin.", "oui oui oui", "oui oui oui oui", ". . . . .", "a  b", "la la la la lac", "un deux " * 5]
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 5)):
            gram = [rng.choice(["a", "b", "c", ".", "d,"]) for _ in range(rng.randint(1, 4))]
            parts += gram * rng.randint(1, 6)
        texts.append(" ".join(parts))
    got = values(spark, T.collapse_loops, *texts)
    for t, g in zip(texts, got):
        assert g == brute_collapse(t), t


def test_spoken_text(spark):
    assert values(spark, R.spoken_times, "à neuf heures et demie", "Neuf heures moins le quart.", "une heure", "vingt-deux heures 15", "deux mille", "dix heures pile et onze heures") == [
        "à 9h30", "8h45.", "1h", "22h15", "deux mille", "10h et 11h"]
    assert values(spark, R.spelled_words, "C A S T E.fr", "un A-P-I ici", "il y a", "N O U V I A L E") == ["caste.fr", "un API ici", "il y a", "nouviale"]
    assert values(spark, R.spoken_punctuation, "[A] (0:01) luc arobase x.fr", "un point c'est tout") == ["[A] (0:01) luc@x.fr", "un point c'est tout"]


def test_clock(spark):
    assert values(spark, C.clock_parse_ms, "1:02:03.5", "02:03", "12,25", "-4", "soon", "") == [3723500, 123000, 12250, 0, None, None]


@pytest.mark.parametrize("family", [("Mollie", "MOLI", "Molli", "Moly"), ("Sudokies", "Sudokiz", "Sudokis"), ("Symphonat", "Symphonate"), ("Klarna", "Clarna")])
def test_phonetic_families(spark, family):
    assert len(set(values(spark, phonetic_key, *family))) == 1


def test_close_pairs(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(150)})
    a = spark.createDataFrame([(w,) for w in words[::2]], "x string")
    b = spark.createDataFrame([(w,) for w in words[1::2]], "y string")

    def lev(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    for k in (1, 2):
        got = {(r.x, r.y) for r in glossary.close_pairs(a, "x", b, "y", k).collect()}
        assert got == {(s, t) for s in words[::2] for t in words[1::2] if lev(s, t) <= k}


@pytest.mark.parametrize("crowd", [40, 2000])
def test_meetings_near_in_a_crowded_hour(spark, crowd):
    rng = random.Random(crowd)
    base, minute = 1_700_000_400, 60  # a full hour is in between
    meets = []
    for i in range(crowd):
        start = base + rng.choice([0, 600, rng.randrange(7200), rng.randrange(-9000, 9000)])
        stop = start + rng.choice([0, 1, minute, 30 * minute, rng.randrange(1, 9000)])
        meets.append((i, float(start) + rng.choice([0, 0.25]), float(stop) + rng.choice([0.25, 0.5]), [1, 2]))
    asked = [(i, float(base + rng.choice([0, 1800, rng.randrange(-9000, 12000)])) + rng.choice([0, 0.25, 0.4])) for i in range(150)]
    m = spark.createDataFrame(meets + [(-1, None, float(base), [1, 2]), (-2, base + 900.0, base - 900.0, [1, 2])], "meeting_id long, a double, z double, partner_ids array<long>")
    m = m.select("meeting_id", F.col("a").cast("timestamp").alias("start_at"), F.col("z").cast("timestamp").alias("stop_at"), "partner_ids")
    rec = spark.createDataFrame(asked, "rec_id long, n double").select("rec_id", F.col("n").cast("timestamp").alias("near"))
    who = spark.createDataFrame([(1, "a", "", ""), (2, "b", "", "")], "partner_id long, name string, email string, company string")
    got = {}
    for r in joins.meetings_near(rec, m, who, 0.5).orderBy("rec_id", "rank").collect():
        got.setdefault(r.rec_id, []).append(r.meeting_id)
    for i, near in asked:
        want = [x for _, x in sorted((a, x) for x, a, z, _ in meets if a <= near + 1800 and z >= near - 1800)][:10]
        assert got.get(i, []) == want, i


# ------------------------------------------------------------------ glossary and corrections

def apply_terms(spark, text, terms, windows=False):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    t = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, pos long")
    r = glossary.apply_glossary(df, ["id"], t, windows=windows).collect()[0]
    return r.text, [(s.original, s.replacement, s.method) for s in r.subs]


def test_pairs_by_pieces_are_all_pairs(spark):
    rng = random.Random(11)
    def edited(t):
        t = list(t)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randrange(2)] = rng.choice(["", "A", "B"])
        return "".join(t)

    base = ["".join(rng.choice("AB") for _ in range(rng.randrange(4, 15))) for _ in range(150)]
    right = [(rng.choice("xy"), t) for t in base] + [("x", ""), (None, "ABABABABAB"), ("x", None)]
    left = [(rng.choice("xy"), edited(t)) for t in base for _ in range(3)] + [("x", ""), (None, "ABABABABAB"), ("x", None), ("x", "A" * 400)]
    limit = lambda n: 0 if n <= 5 else 1 if n <= 8 else 2

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {
        (g, a, b, distance(a, b)) for g, a in left for h, b in right
        if g and g == h and a and b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= limit(len(b))}
    out = glossary.pairs_by_pieces(
        spark.createDataFrame(left, "g string, l string"), "l", spark.createDataFrame(right, "g string, r string"), "r",
        lambda n: F.when(n <= 5, 0).when(n <= 8, 1).otherwise(2), 2, "g")
    got = [(r.g, r.l, r.r, r.distance) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_glossary(spark):
    assert apply_terms(spark, "On paie avec MOLI, puis Clarna.", ["Mollie", "Klarna"]) == (
        "On paie avec MOLLIE, puis Klarna.", [("MOLI", "MOLLIE", "phonetic"), ("Clarna", "Klarna", "phonetic")])
    assert apply_terms(spark, "avec mollie", ["Mollie"])[1] == []
    assert apply_terms(spark, "le Contrôle par allait", ["Control", "Parce", "Allix"])[1] == []
    assert apply_terms(spark, "il faut pouvoir bien voir", ["Power BI"])[1] == []
    assert apply_terms(spark, "il faut pouvoir bien noter", ["Power BI"], True) == ("il faut Power BI noter", [("pouvoir bien", "Power BI", "merged_window")])


def test_corrections(spark):
    text = spark.createDataFrame([(1, "Adèle parle. adele  parle de MOLI et MOLI et MOLI et MOLI et MOLI, au doubs.")], "id long, text string")
    fixes = spark.createDataFrame([
        (1, 1, "0:01", "Adele parle", "Adèle parla", 0.9), (1, 2, "0:02", "MOLI", "Mollie", 0.9), (1, 3, "", "zzz", "zzy", 0.9), (1, 4, "", "parle", "parlé", 0.5),
        (1, 5, "", "Adèle", "adele", 0.9), (1, 6, "", "", "x", 0.9), (1, 7, "0:09", "au doubs", "au doute", 0.9), (1, 8, "0:08", "et", "tout autre chose", 0.9),
    ], "id long, seq long, timestamp string, original string, replacement string, confidence double")
    terms = spark.createDataFrame([("Odoo", 1)], "term string, pos long")
    r = corrections.apply_corrections(text, fixes, terms).collect()[0]
    assert {c.seq: (c.outcome, c.occurrences) for c in r.log} == {
        1: ("applied", 2), 2: ("applied", 4), 3: ("not_found", 0), 4: ("low_confidence", 0), 5: ("noop_after_normalization", 0), 6: ("empty", 0),
        7: ("betrays_glossary", 0), 8: ("too_distant", 0)}
    assert r.text == "Adèle parla. Adèle parla de Mollie et Mollie et Mollie et Mollie et MOLI, au doubs."


def test_proper_nouns(spark):
    rows = [(1, 0, "Avec Odoo on facture"), (1, 1, "Voir Odoo et Oudou"), (1, 2, "Chez Oudou ou Zindoc"), (1, 3, "Pour Zindoc, Zindoc Zindoc Zindoc"), (1, 4, "Le Castel du Castel")]
    df = spark.createDataFrame(rows, "job_id long, seq long, text string")
    known = spark.createDataFrame([("Castell",)], "term string")
    assert [r.term for r in mining.proper_nouns(df, known).orderBy("rank").collect()] == ["Odoo"]


def test_words_before_names(spark, monkeypatch):
    monkeypatch.setattr(mining, "GATHERED", 3)
    def plain(words, found):
        out, used = [], 0
        for m in found:
            at = next((i for i in range(used, len(words)) if words[i] == m), None)
            out.append(words[at - 1].lower() if at else "<BOS>")
            used = len(words) if at is None else at + 1
        return out

    rng = random.Random(2)
    rows = [(["a", "B", "c", "B", "D"], ["B", "B", "D"]), (["a", "B"], ["X", "B"]), ([], ["Q"]), (["B", "x"], [])]
    for _ in range(60):
        words = [rng.choice("abAB") for _ in range(rng.randint(0, 30))]
        rows.append((words, [w for w in words if w in "AB" and rng.random() < 0.9] + rng.choice([[], ["C"], ["A"]])))
    got = spark.createDataFrame(rows, "w array<string>, m array<string>").select("w", "m", mining.preceding_words(F.col("w"), F.col("m")).alias("p")).collect()
    assert [r.p for r in got] == [plain(r.w, r.m) for r in got]


def plain_families(words):
    """The ordered walk over (sound, strength) of one job."""
    def one_edit(a, b):
        return a == b or any(a[:i] + x + a[i + d:] == b for d in (0, 1) for i in range(len(a) + 1) for x in {"", *b})

    out = []
    for sound, _ in sorted(words, key=lambda w: w[1]):
        if not any(one_edit(sound, other) for other in out):
            out.append(sound)
    return set(out)


def test_families_equal_the_ordered_walk(spark):
    rng = random.Random(6)
    rows = []
    for job in range(12):
        sounds = sorted({"".join(rng.choice("ABK") for _ in range(rng.randint(1, 6))) for _ in range(rng.choice([1, 8, 60, 200]))})
        rows += [(job, s, n) for s, n in zip(sounds, rng.sample(range(1000), len(sounds)))]
    # a long chain: each sound next to the one before it
    rows += [(99, "AK" * 20 + "B" * i, i) for i in range(25)]
    df = spark.createDataFrame(rows, "job_id long, sound string, strength long")
    got = {}
    for r in mining._claimed(df).collect():
        got.setdefault(r.job_id, []).append(r.sound)
    assert all(len(v) == len(set(v)) for v in got.values())
    assert {j: set(v) for j, v in got.items()} == {j: plain_families([r[1:] for r in rows if r[0] == j]) for j in {r[0] for r in rows}}


def test_entities_confirmed_in_a_corpus(spark):
    cand = spark.createDataFrame([(1, 1, "Marie Curie"), (1, 2, "Zindoc"), (1, 3, "Nobody"), (1, 4, "Odoo")], "id long, rank long, term string")
    known = spark.createDataFrame([("odoo",)], "term string")
    corpus = spark.createDataFrame([("b", "x", "les zindocs sont là"), ("a", "y", "marie curieuse"), ("c", "z", "zindoc et Marie Curie")], "source_id string, title string, text string")
    got = {r.term: r.source_id for r in joins.confirm_entities(cand, known, corpus).collect()}
    assert got == {"Marie Curie": "a", "Zindoc": "b"}


# ------------------------------------------------------------------ joins

def test_overlap_and_words(spark):
    seg = turns_df(spark, [(1, 0, 0, 2000, None), (1, 1, 90_000, 90_500, None)])
    turns = turns_df(spark, [(1, 0, 0, 500, "A"), (1, 1, 500, 2000, "B")])
    got = {r.seq: r.speaker for r in joins.overlap_speakers(seg, turns).collect()}
    assert got == {0: "B", 1: None}


def test_remap(spark):
    spans = spark.createDataFrame([(1, 0, 12_000, 20_000, 0, 8_000), (1, 1, 60_000, 70_000, 12_000, 22_000)], "job_id long, seq long, src_start long, src_end long, trim_start long, trim_end long")
    rows = turns_df(spark, [(1, 0, 0, 6_000, None), (1, 1, 14_000, 18_000, None), (1, 2, 30_000, 31_000, None), (2, 0, 5, 6, None)])
    got = {(r.job_id, r.seq): (r.start_ms, r.end_ms) for r in joins.remap_segments(rows, spans, ["job_id", "seq"]).collect()}
    assert got == {(1, 0): (12_000, 18_000), (1, 1): (62_000, 66_000), (1, 2): (70_000, 70_000), (2, 0): (5, 6)}


def test_voices_are_never_missed(spark, monkeypatch):
    for name, value in (("FAN", 3), ("LEAF_ROWS", 4)):
        monkeypatch.setattr(speakers, name, value)
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    people = [(f"p{i:03d}", vec()) for i in range(120)]
    people += [(f"q{i:03d}", people[7][1]) for i in range(30)]  # many of one vector
    people += [(f"r{i:03d}", [x + 1e-9 * i for x in people[8][1]]) for i in range(20)]  # closer than angles can tell
    voices = [(1, f"v{i:02d}", vec()) for i in range(40)] + [(1, "w", people[7][1])]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    p = spark.createDataFrame(people, "name string, embedding array<double>")
    v = spark.createDataFrame(voices, "job_id long, speaker string, embedding array<double>")
    ranked = {s: sorted(((-cos(e, q), n) for n, q in people)) for _, s, e in voices}
    best = {r.speaker: r.name for r in speakers.best_profiles(v, p, ["job_id", "speaker"], 0.75).collect()}
    assert best == {s: r[0][1] for s, r in ranked.items() if -r[0][0] >= 0.75}
    top = {}
    for r in speakers.top_profiles(v, p, ["job_id", "speaker"], 3).orderBy("speaker", "rank").collect():
        top.setdefault(r.speaker, []).append(r.name)
    # names of vectors that differ by 1e-9 count as one here
    same = lambda ns: ["r" if n[0] == "r" or n == "p008" else n for n in ns]
    assert {s: same(ns) for s, ns in top.items()} == {s: same(n for _, n in r[:3]) for s, r in ranked.items()}


def test_ball_tree_grows_with_the_profiles(spark, monkeypatch):
    """No group above a leaf, and ten times the profiles give at most fifteen times the pairs."""
    monkeypatch.setattr(speakers, "LEAF_ROWS", 16)
    rng = random.Random(9)
    homes = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(400)]
    near = lambda h: [x + rng.gauss(0, 0.03) for x in h]
    pairs = []
    for n in (200, 2000):
        clusters = homes[: n // 20]
        people = [(f"p{i}", near(clusters[i % len(clusters)])) for i in range(n)]
        voices = [(i, near(clusters[i % len(clusters)])) for i in range(n // 4)]
        _, tree = speakers._points(spark.createDataFrame(people, "name string, embedding array<double>"), 1)
        assert tree.points.count() == n and tree.points.groupBy("dim", "node").count().agg(F.max("count")).first()[0] <= speakers.LEAF_ROWS
        asked = speakers._unit_rows(spark.createDataFrame(voices, "k long, embedding array<double>"), ["k"]).withColumnRenamed("u", "v")
        pairs.append([speakers.compared(asked.withColumn("limit", F.lit(math.acos(0.95))), tree, ["k"]).count(),
                      speakers.compared(speakers._near_limit(asked, tree, ["k"], 3), tree, ["k"]).count()])
    assert all(b <= 15 * a for a, b in zip(*pairs)), pairs


@pytest.mark.parametrize("most", [1, 4, 512])
def test_terms_of_crowded_runs(spark, monkeypatch, most):
    monkeypatch.setattr(aggregates, "PAIR_TERMS", most)
    rng = random.Random(most)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([f"t{i}" for i in range(25)] + [" T3 ", "", None])) for _ in range(300)]
    spelled = {}
    for run, term in rows:
        if run is not None and term and term.strip():
            seen = spelled.setdefault(run, {})
            seen[term.strip().lower()] = min(term.strip(), seen.get(term.strip().lower(), term.strip()))
    want = {}
    for terms in spelled.values():
        for a in terms.values():
            for b in terms.values():
                if a != b:
                    want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(rows, "run long, term string")
    got = [((r.term, r.other), r.runs) for r in aggregates.cooccurrence(df).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert aggregates.cooccurrence(df.limit(0)).count() == 0


def test_one_run_with_most_terms_is_spread(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "PAIR_TERMS", 50)
    df = spark.range(3_000).select(F.when(F.col("id") < 1_000, 0).otherwise(F.col("id")).alias("run"), F.concat(F.lit("t"), "id").alias("term"))
    blocks = aggregates._term_blocks(df).groupBy("run", "blk").count().collect()
    assert sum(r.run == 0 for r in blocks) == 20 and max(r["count"] for r in blocks) < 100


def test_redact(spark):
    from colloquy.operators.library import redact

    text = '{"a":{"token":"x\\"y","n":[{"password":12},{"password":0}]},"api_key":{"k":["}"]},"hf_token":"","token":true}'
    assert values(spark, redact, text) == ['{"a":{"token":"[redacted]","n":[{"password":"[redacted]"},{"password":0}]},"api_key":"[redacted]","hf_token":"","token":"[redacted]"}']


def test_redact_at_any_depth(spark):
    from colloquy.operators.library import redact

    deep = '{"x":' * 9 + '1' + "}" * 9
    text = '{"keep": "token", "n": {"token" : %s, "password":[[[[[[[[["s"]]]]]]]]], "api_key":{}, "hf_token": [ ], "token":-0.5, "password":0.0, "z":"a\\"{"}}' % deep
    want = '{"keep": "token", "n": {"token" : "[redacted]", "password":"[redacted]", "api_key":{}, "hf_token": [ ], "token":"[redacted]", "password":0.0, "z":"a\\"{"}}'
    assert values(spark, redact, text) == [want]


def test_deep_answers(spark):
    from colloquy.sources.payloads import title_answers

    deep = '{"x":' * 9 + '"}"' + "}" * 9
    rows = [("a", 'Sure! {"title": "T", "more": %s, "terms": ["u"]} done {' % deep), ("b", 'no { "title": "T"'), ("c", "plain")]
    got = {r.id: (r.title, r.technical_terms) for r in title_answers(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {"a": ("T", ["u"]), "b": ("", []), "c": ("", [])}


def test_chatter_after_many_blank_messages(spark):
    from colloquy.operators.mining import chatter_summary

    rows = [("r", i, None, "A", " ") for i in range(700)] + [("r", 700 + i, "2024-01-01", "A", f"word{i}") for i in range(49)]
    got = chatter_summary(spark.createDataFrame(rows, "id string, rank int, date string, author string, body string"), spark.createDataFrame([("r", "N")], "id string, name string")).collect()
    assert got[0].summary.startswith("N. ") and "word0" in got[0].summary and "word48" in got[0].summary


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    import pytest

    from colloquy import stage

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError):
        stage.shared_folder(Session())


def test_streams_do_not_hang_on_files_or_their_order(spark, tmp_path):
    """Usage 90 days apart, repeats and late first events: one file a batch in either order, or all at once."""
    import json
    import os

    from colloquy.streaming import events as E

    day = lambda d, s=0: f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}T00:00:{s:02d}.000000Z"
    files = [
        [{"ts": day(100), "job_id": 1, "event": "usage", "step": "a", "provider": "p", "model": "m", "input_tokens": 1, "output_tokens": 1, "cost_micro": 5}, {"ts": day(100, 30), "job_id": 2, "event": "progress", "pct": 5.0}],
        [{"ts": day(0), "job_id": 3, "event": "usage", "step": "a", "provider": "p", "model": "m", "input_tokens": 2, "output_tokens": 2, "cost_micro": 7}, {"ts": day(100, 10), "job_id": 2, "event": "warning", "code": "slow"}],
        [{"ts": day(150), "job_id": 1, "event": "usage", "step": "a", "provider": "p", "model": "m", "input_tokens": 1, "output_tokens": 1, "cost_micro": 5}],
    ]
    totals = spark.createDataFrame([(2, 100.0)], "job_id long, total_seconds double")
    found = set()
    for k, (order, at_once) in enumerate((((0, 1, 2), 1), ((2, 1, 0), 1), ((0, 1, 2), 1_000))):
        folder = tmp_path / str(k)
        folder.mkdir()
        for n, i in enumerate(order):
            (folder / f"{n}.json").write_text("".join(json.dumps(x) + "\n" for x in files[i]))
            os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
        read = lambda: E.read_events(spark, str(folder), at_once)
        billed = sorted((r.job_id, r.step) for r in E.collect_stream(E.billed_once(read()).select("job_id", "step"), "billed").collect())
        eta = [(r.job_id, r.eta_seconds) for r in E.etas(read(), totals).collect()]
        usage = sorted(map(tuple, E.keep_latest(E.usage_totals(read()), ["month", "provider", "model"], "usage").collect()))
        found.add(repr((billed, eta, usage)))
    assert len(found) == 1 and "[(1, 'a'), (3, 'a')], [(2, 80.0)]" in found.pop()
