import random
import time

from foldspark.llm import decontamination as dc


def tables(spark, docs, items):
    d = spark.createDataFrame([(k, t, "c", 2) for k, t in docs], "doc_id long, text string, item_id string, bucket int")
    return d, spark.createDataFrame(items, "item_id long, text string")


QUESTION = "Tom buys 12 apples for 3 dollars each and sells them to Anna for 5 dollars each so how much money does Tom earn from the 12 apples in total"


def test_templates(spark):
    changed = QUESTION.replace("Tom", "Boris").replace("Anna", "Clara").replace("12", "70").replace("3 ", "9 ")
    mixed = QUESTION.replace("12", "70", 1).replace("Tom", "Boris")
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet zeta eta".split()) for _ in range(n))
    docs = [
        (1, f"{noise(30)} {QUESTION} {noise(20)}"), (2, f"{noise(30)}. {changed}, {noise(9)}"), (3, noise(5) + " " + mixed), (4, noise(300)), (5, None), (6, ""), (7, "! | ?"),
        (8, QUESTION[:40]), (9, "what is love"), (10, f"x What is love? y"), (11, noise(20_000) + QUESTION), (1, QUESTION), (None, QUESTION.upper()),
    ]
    d, b = tables(spark, docs, [(100, QUESTION), (101, "What is love"), (102, "hi"), (103, None), (104, ""), (105, QUESTION)])
    got = sorted((str(r.doc_id), r.item_id, round(r.cover, 2), r.n_slots, r.n_changed) for r in dc.leaks(d, b).collect())
    hit = {(k, i) for k, i, *_ in got}
    assert {("1", 100), ("1", 105), ("2", 100), ("11", 100), ("9", 101), ("10", 101)} <= hit
    assert {k for k, _ in hit} <= {"1", "2", "11", "9", "10", "None"}
    assert [x for x in got if x[:2] == ("2", 100)][0][4] >= 5
    assert {r.doc_id for r in dc.clean(d, b).collect()} == {3, 4, 5, 6, 7, 8} | ({None} if ("None", 100) not in hit else set())
    assert dc.clean(d, b).columns == d.columns
    assert dc.leaks(d.filter("false"), b).count() == 0 and dc.leaks(d, b.filter("false")).count() == 0


def test_table(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    whole = {(k, b.item_id) for b in bench.collect() for k, t in texts.items() if len(b.text.split()) >= 8 and " ".join(b.text.split()) in t}
    assert whole and whole <= got
    # every leak holds half the item's words in order at least, word for word or by kind
    words = {b.item_id: b.text.lower().split() for b in bench.collect()}
    for k, i in got:
        w = texts[k].lower().split()
        grams = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
        mine = words[i]
        assert sum(tuple(mine[j : j + 3]) in grams for j in range(len(mine) - 2)) >= 0.3 * (len(mine) - 2), (k, i)


def test_edited_copies(spark):
    """Changed and inserted words, a long part of a long item, and items of numbers only."""
    item = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(36))
    w = item.split()
    changed = " ".join("other" if i in (10, 24) else x for i, x in enumerate(w))
    inserted = " ".join(w[:18] + ["some", "five", "words", "more", "here"] + w[18:])
    long = " ".join(f"v{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100))
    sums = "What is 12 + 35 - 7 * 3 + 18 / 9 - 4 + 6?"
    docs = [(1, f"lorem {changed} ipsum"), (2, f"lorem {inserted} ipsum"), (3, " ".join(["lorem", *long.split()[30:70], "ipsum"])), (4, f"lorem ipsum. {sums} dolor")]
    docs += [(5, " ".join(w[:9])), (6, " ".join(long.split()[:20])), (7, "lorem ipsum. What is 13 + 35 - 7 * 3 + 19 / 9 - 4 + 6? dolor"), (8, " ".join(w[18:] + w[:9]))]
    d, b = tables(spark, docs, [(100, item), (101, long), (102, sums)])
    got = {(r.doc_id, r.item_id): r.cover for r in dc.leaks(d, b).collect()}
    assert {k: round(v, 2) for k, v in got.items()} == {(1, 100): 0.94, (2, 100): 1.0, (3, 101): 0.4, (4, 102): 1.0, (8, 100): 0.5}


def brute(text, item):
    """The covered part of an item that leaks, else None: canonical words, all pairs of places, all chains, in plain Python."""
    clean = lambda w: "".join(c.lower() for c in w if c.isalnum())

    def tokens(s, first_names):
        words = [w for w in s.split() if clean(w)]
        out = []
        for i, w in enumerate(words):
            core = next(j for j, c in enumerate(w) if c.isalnum())
            begins = w[core].isupper() and w[core + 1 : core + 2].isalpha() and w[core + 1 : core + 2].islower()
            if w[core].isdigit():
                out.append("<number>")
            elif i and clean(w) in dc.UNITS and out[-1] == "<number>":
                out.append("<unit>")
            elif begins and (i > 0 and words[i - 1][-1] not in ".!?:" or i == 0 and first_names):
                out.append("<name>")
            else:
                out.append(clean(w))
        return out, words

    (d, dw), (p, pw), (q, _) = tokens(text, False), tokens(item, False), tokens(item, True)
    n, size = len(p), min(dc.WINDOW, len(p))
    if n < dc.LEAST:
        return None
    value = lambda w: w.strip(".,;:!?()[]{}\"'").lower()
    slots = lambda t: sum(x[0] == "<" for x in t)
    low = [clean(w) for w in pw]
    hits = set()
    for a in range(len(d) - size + 1):
        here, exact = d[a : a + size], [clean(w) for w in dw[a : a + size]]
        for i in range(n - size + 1):
            plain = [x[i : i + size] for x in ([p, q] if i == 0 else [p])]
            if 2 * slots(here) <= size and here in [x for x in plain if 2 * slots(x) <= size] or 2 * (slots(here) + 1) > size and 2 * (slots(p[i : i + size]) + 1) > size and exact == low[i : i + size]:
                hits.add((a, i))
    covered = lambda a, i: any((a - o, i - o) in hits for o in range(size))
    on = {(a, i) for a in range(len(d)) for i in range(n) if covered(a, i)}
    starts = sorted((a, i) for a, i in on if (a - 1, i - 1) not in on)
    runs = []
    for a, i in starts:
        k = next(k for k in range(1, n + 2) if (a + k, i + k) not in on)
        runs.append((a, i, k))
    chains, best, exact = [], 0, 0
    for a, i, k in runs:
        run = 0
        for o in range(k):
            run = run + 1 if clean(dw[a + o]) == low[i + o] else 0
            exact = max(exact, run)
        own = None
        for c in [(0, a, i, {}), *chains]:
            over = max(0, c[1] - a, c[2] - i)
            if over >= k or a + over - c[1] > n:
                continue
            stands, ok = dict(c[3]), True
            for o in range(over, k):
                if d[a + o][0] == "<":
                    ok &= stands.setdefault(value(pw[i + o]), value(dw[a + o])) == value(dw[a + o])
            if ok and (own is None or c[0] + k - over > own[0]):
                own = c[0] + k - over, a + k, i + k, stands
        if own:
            chains.append(own)
            best = max(best, own[0])
    return best / n if best >= dc.COVER * n else exact / n if exact >= dc.RUN else None


def test_brute_force(spark):
    """Random items in random documents, with changed slots and words, insertions, ties and repeats."""
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "of", "is", "the", "3", "12", "Tom", "Anna", "km", "sum.", "So", "(x", "7,"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 5, 7, 8, 9, 14, 30, 50]))) for _ in range(25)] + ["word " * 20, "", None, "a b a b a b a b a b a b"]
    docs = []
    for k in range(450):
        w = rng.choice(items[:25]).split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(["12", "99", "Boris", "Tom", "epsilon", "", "delta delta"])]
        noise = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))
        docs.append((k, f"{noise()} {' '.join(w)} {noise()}"))
    docs += [(900, "word " * 60), (901, "a b " * 30), (902, None), (903, "word " * 7)]
    d, b = tables(spark, docs, list(enumerate(items)))
    got = {(r.doc_id, r.item_id): r.cover for r in dc.leaks(d, b).collect()}
    want = {(k, i): c for k, t in docs for i, x in enumerate(items) if (c := brute(t or "", x or "")) is not None}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    assert len(want) > 100


def test_long_repeats():
    """Repeated words in the document and the item: time about in proportion to the document."""
    def seconds(n, item):
        block = dc.Block([(1, item.encode())])
        t = time.time()
        got = list(block.leaks([("word " * n).encode()]))
        return time.time() - t, got

    for item in ("word " * 250, "word " * 100 + " ".join(f"x{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150))):
        seconds(1000, item)
        (one, got), (eight, more) = seconds(10_000, item), seconds(80_000, item)
        assert [x[1:3] for x in got] == [x[1:3] for x in more] and eight < 16 * one + 5, (one, eight)
