from __future__ import annotations

from cases import frame

from stagegraph.llm.decontamination import contaminated

ITEM = "A train leaves Boston at 60 km per hour and Alice boards it with 3 friends before the train reaches Denver with Alice inside"


def found(spark, docs, items=((1, ITEM),), **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, h string, item_id string")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in contaminated(d, b, **kw).collect()}


def test_verbatim_and_reparameterised_passages(spark):
    other = ITEM.replace("Boston", "London").replace("60 km", "75 mi").replace("Alice", "Bob").replace("3", "nine").replace("Denver", "Paris")
    docs = [
        (1, f"so it goes. {ITEM} and on", "", ""), (2, ITEM.upper(), "", ""), (3, f"x {other} y", "", ""), (4, f"x {other.replace('with Bob inside', 'with Carl inside')} y", "", ""),
        (5, "A train of thought leaves nobody at peace", "", ""), (6, None, "", ""), (7, "", "", ""), (None, ITEM, "", ""), (1, f"so it goes. {ITEM} and on", "", ""), (8, ITEM.replace(" ", " | "), "", ""),
    ]
    got = found(spark, docs)
    assert {d for d, _ in got} >= {1, 3, 8, None} and not {d for d, _ in got} & {4, 5, 6, 7}
    assert got[(1, 1)].n_changed == 0 and got[(3, 1)].n_changed == 6


def test_short_items_and_empty_sides(spark):
    assert set(found(spark, [(1, "say it again green little words here", "", ""), (2, "green little", "", "")], [(1, "green little words here"), (2, "little"), (3, None), (4, "")])) == {(1, 1)}
    assert found(spark, [(1, ITEM, "", "")], []) == {}
    assert found(spark, [], [(1, ITEM)]) == {}


def test_all_odd_documents(spark):
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert contaminated(frame(spark), b).count() == 0


def test_whole_items_of_the_tables(spark, sf_dir):
    import re

    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    texts = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    wanted = {(d, i.item_id) for i in items.collect() for d, t in texts if plain(i.text) in t}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == wanted


def test_items_of_numbers_names_and_units_are_found_word_for_word(spark):
    items = [(1, "What is 15 * 3 + 7?"), (2, "Paris 1900 25 kg"), (3, "12 14 16"), (4, "1 2 3 4 5 6 7 8 9 10 11 12 and 13 14 15 16 17 18 19")]
    docs = [(i, f"so it was asked: {text} and no more", "", "") for i, text in items] + [(10, "What is 16 * 3 + 8?", "", ""), (11, "12 15 16, Rome 1900 25 kg", "", ""), (12, "1 2 4 3 5 7 6 8 10 9 11", "", "")]
    got = found(spark, docs, items)
    assert set(got) == {(i, i) for i, _ in items}
    assert all(r.coverage == 1 and r.n_changed == 0 for r in got.values())


def test_capitalised_words_at_the_start_of_sentences(spark):
    items = [(1, "Maria has 4 apples. Maria buys 3 more."), (2, "Carol walks home with bread today"), (3, "What did Peter take along? Peter ran to town. Peter sold wood there. Peter came back.")]
    docs = [
        (1, "Anna has 5 apples. Anna buys 2 more.", "", ""), (2, "Anna has 5 apples. Berta buys 2 more.", "", ""), (3, "Q: Maria has 4 apples. Maria buys 3 more.", "", ""),
        (4, "Question Carol walks home with bread today", "", ""), (5, "Question: Doris walks home with bread today", "", ""),
        (6, "so what did Emil take along? Emil ran to town. Emil sold wood there. Emil came back.", "", ""),
    ]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (3, 1), (4, 2), (5, 2), (6, 3)}
    assert got[(1, 1)].n_changed == 3 and got[(3, 1)].n_changed == got[(4, 2)].n_changed == 0 and got[(5, 2)].n_changed == got[(6, 3)].n_changed == 1


def test_cases_of_an_earlier_review(spark):
    items = [(1, "What is the capital of Burkina Faso"), (2, "Evaluate 3 + 4 * 5 - 6 / 2 exactly"), (3, "A bag holds 3 red balls and 5 blue balls so how many balls are in the bag")]
    docs = [(1, "Q: What is the capital of Burkina Faso", "", ""), (2, "Evaluate 3 + 4 * 5 - 6 / 2 exactly", "", ""), (3, "A bag holds 9 red balls and 9 blue balls so how many balls are in the bag", "", ""), (4, "A bag of rice is what the capital needs exactly", "", "")]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 2), (3, 3)}


def brute(docs, items, width=8, least=0.6, run=20):
    """The same rule, window by window in plain Python."""
    import itertools

    from stagegraph.llm.decontamination import LITERALS, NAME, NUMBER, Canon

    canon = Canon()

    def windows(text, w):
        """(place, readings): for each window its literal words, and (template, slot values, plainly) of its readings."""
        values, literal, slot, begins, number, _ = canon.templates([(text or "").encode()])
        name = [f"slot {NAME}"]
        words = [canon.plain[i] for i in number]
        shown = [(f"slot {canon.kind[i]}" if s else canon.plain[i]) for i, s in zip(number, slot, strict=True)]
        for at in range(len(words) - w + 1):
            span = range(at, at + w)
            open_ = [i for i in span if begins[i]]
            readings = []
            for names in itertools.product((False, True), repeat=len(open_)):
                as_name = {i for i, n in zip(open_, names, strict=True) if n}
                slots = [i for i in span if slot[i] or i in as_name]
                if w - len(slots) >= LITERALS:
                    readings.append((tuple(name[0] if i in as_name else shown[i] for i in span), [words[i] for i in slots], not as_name, len(as_name) in (0, len(open_))))
            yield at, tuple(words[at : at + w]), readings

    assert NUMBER
    for (d, dt), (i, it) in itertools.product(docs, items):
        n = len(canon.templates([(it or "").encode()])[4])
        w = min(width, n)
        if w < 2:
            continue
        aligned, mine = {}, list(windows(it, w))
        for (p, words, readings), (q, others, their) in itertools.product(windows(dt, w), mine):
            if words == others:
                aligned.setdefault((0, p - q), []).append((q, []))
            for (t, s, plain, ends), (u, v, first, _) in itertools.product(readings, their):
                if t == u and ends:
                    for reading in (1, 2) if plain and first else (2,):
                        aligned.setdefault((reading, p - q), []).append((q, list(zip(v, s, strict=True))))
        covered = set()
        for hits in aligned.values():
            pairs = {x for _, some in hits for x in some}
            if len(pairs) == len({a for a, _ in pairs}):
                covered |= {t for q, _ in hits for t in range(q, q + w)}
        if covered and (len(covered) / n >= least or len(covered) >= run):
            yield d, i, len(covered)


def test_templates_by_brute_force(spark):
    import random

    rng = random.Random(4)
    names, units, words = ["Alice", "Bob", "Carol", "Dan"], ["km", "kg", "miles"], [f"w{i}" for i in range(12)]

    def sentence(n):
        out = []
        while len(out) < n:
            kind = rng.random()
            out += [rng.choice(names)] if kind < 0.2 else [str(rng.randrange(4)), rng.choice(units)] if kind < 0.3 else [str(rng.randrange(30))] if kind < 0.4 else [rng.choice(words) + rng.choice(["", "", "", "."])]
        return out

    def changed(text):
        swap = dict(zip(names, rng.sample(names, 4), strict=True)) if rng.random() < 0.5 else {}
        number = {str(i): str(rng.randrange(5) if rng.random() < 0.5 else i) for i in range(30)}
        return [number.get(x, swap.get(x, x)) if rng.random() < 0.97 else rng.choice(words) for x in text]

    items = [(i, sentence(rng.choice([3, 6, 9, 15, 30]))) for i in range(25)]
    docs = [(100 + i, sentence(rng.randrange(6)) + changed(rng.choice(items)[1]) + sentence(rng.randrange(6))) for i in range(80)]
    items, docs = ([(i, " ".join(t)) for i, t in some] for some in (items, docs))
    wanted = sorted(brute(docs, items))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_covered) for r in got) == wanted and 60 < len(wanted) < len(docs) * len(items)


def test_long_texts_ties_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(2_000))
    docs = spark.createDataFrame([(1, f"{long} {ITEM} " + "other words " * 200_000, "a", 1, "x"), (2, f"{ITEM} {ITEM}", "b", 2, "y"), (2, ITEM, "b", 2, "y")], "doc_id long, text string, coverage string, n_windows int, reading string")
    items = spark.createDataFrame([(1, ITEM, 5, "a", "z"), (1, ITEM, 5, "a", "z"), (2, ITEM, 6, "b", "z"), (3, long, 7, "c", "z"), (None, ITEM, 8, "d", "z")], "item_id long, text string, n_tokens int, h string, literal string")
    got = {(r.doc_id, r.item_id): r.coverage for r in contaminated(docs, items).collect()}
    assert got == {(d, i): 1.0 for d in (1, 2) for i in (1, 2, None)} | {(1, 3): 1.0}
