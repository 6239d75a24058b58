import collections
import random

import regex

from recordlens.llm import decontaminate as dc
from tests.llm.conftest import SF

ITEM = ("If Tom has 12 apples and gives Mary 5 apples how many of the 12 apples does Tom keep "
        "after 3 km of walking")
OTHER = ("If Ann has 30 apples and gives Bob 7 apples how many of the 30 apples does Ann keep "
         "after 9 km of walking")


def test_templates_and_slots(spark):
    rows = [
        (1, ITEM), (2, f"before it. {OTHER} and after"),
        (3, OTHER.replace("of the 30", "of the 31")),  # two values for one slot
        (4, OTHER.replace("km", "pears")),  # another type, but most is the same
        (5, ITEM[:40]), (6, None), (7, ""), (8, "unrelated words " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short")],
                                  "item_id long, text string")
    found = dc.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id): r.reparameterised for r in found} == {
        (1, 1): False, (2, 1): True, (4, 1): True}
    left = dc.remove_contaminated(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 7, 8]


def plain_template(text):
    """Words as (sign or word, value)."""
    for c in dc.SIGNS:
        text = (text or "").replace(c, " ")
    values = []
    for sign, pattern in dc.PATTERNS:
        pattern = regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), pattern)
        values.append((sign, iter([m.strip().lower() for m in regex.findall(pattern, text)
                                   if isinstance(m, str)])))
        text = regex.sub(pattern, f" {sign} ", text)
    values = dict(values)
    words = [w for w in regex.split(rf"[^\p{{L}}\p{{N}}{dc.SIGNS[:3]}]+", text.lower()) if w]
    return [(w, next(values[w])) if w in values else (w, None) for w in words]


def brute(docs, items, width=8, min_literal=4, min_words=4):
    index, sizes = collections.defaultdict(list), {}

    def windows(words, spans):
        for span in spans:
            for at in range(len(words) - span + 1):
                part = words[at:at + span]
                own = [(w, v) for w, v in part if v is not None]
                if span < width or len(own) > width - min_literal:
                    yield (span, tuple(v or w for w, v in part)), at, ()
                else:
                    yield (span, tuple(w for w, _ in part), "bare"), at, tuple(own)

    for n, (item, text) in enumerate(items):
        words = plain_template(text)
        sizes[n] = item, len(words)
        if len(words) >= min_words:
            for key, at, own in windows(words, [min(len(words), width)]):
                index[key].append((n, at, own))
    found = set()
    for doc, text in docs:
        aligned = collections.defaultdict(list)
        for key, at, own in windows(plain_template(text), range(min_words, width + 1)):
            for n, item_at, item_own in index.get(key, ()):
                aligned[n, at - item_at].append((item_at, key[0], item_own, own))
        held = collections.defaultdict(set)
        for (n, _), hits in aligned.items():
            pairs = {p for _, _, a, b in hits for p in zip(a, b, strict=True)}
            if len({a for a, _ in pairs}) == len(pairs):
                held[n].update(i for at, span, _, _ in hits for i in range(at, at + span))
        found |= {(doc, sizes[n][0]) for n, c in held.items() if len(c) >= 0.5 * sizes[n][1]}
    return found


def check(spark, docs, items):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(a, b).collect()}
    assert found == brute(docs, items)
    return found


def test_slot_values_are_those_of_the_text(spark):
    text = "He paid Anna 1,200.50 euros for 3kg or 20% of it."
    df = spark.createDataFrame([(text,)], "t string")
    row = dc.templates(df, "t", 4, 2, []).first()
    back = str.maketrans(dc.SIGNS[3:], dc.IN_VALUES)
    assert [(w[0], w[1:].translate(back)) for w in row.words if w[0] in dc.SIGNS] == [
        (dc.NAME, "anna"), (dc.NUMBER, "1,200.50"), (dc.UNIT, "euros"), (dc.NUMBER, "3"),
        (dc.UNIT, "kg"), (dc.NUMBER, "20"), (dc.UNIT, "%")]
    assert len(row.windows) == len(row.words) - 3
    assert [(w if v is None else w, v) for w, v in plain_template(text)] == [
        (w[0] if w[0] in dc.SIGNS else w, w[1:].translate(back) if w[0] in dc.SIGNS else None)
        for w in row.words]


def test_table_against_brute_force(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet")
             .select("item_id", "text").collect()]
    assert check(spark, [(r.doc_id, r.text) for r in docs.collect()], items)


def test_items_dense_in_numbers_and_short_items(spark):
    dense = "Convert 3 km 5 m 20 cm 7 mm and 2 kg 30 g 4 mg into base units"
    items = [(1, dense), (2, "What is 17 plus 25"), (3, "Years 1990, 1991, 1992, 1993, 1994, 1995"),
             (4, "one two three"), (5, "Is Paris larger than Rome today"), (5, "other text of four")]
    docs = [(1, dense), (2, f"see: {dense.lower()}!"), (3, dense.replace("3 km", "4 km")),
            (4, "So What is 17 plus 25? Yes"), (5, "what is 17 plus 26"), (6, "what is 17 plus 25"),
            (7, items[2][1]), (8, "Years 1990, 1991, 1992, 1993, 1994, 1996"), (9, "one two three"),
            (10, "is paris larger than rome today"), (11, "an other text of four words"), (12, None)]
    found = check(spark, docs, items)
    assert {(1, 1), (2, 1), (4, 2), (6, 2), (7, 3), (10, 5), (11, 5)} <= found
    assert not {d for d, _ in found} & {5, 9, 12}


def test_fuzzed_items_with_slots(spark):
    pick = random.Random(11)
    words = ["has", "gives", "of", "Tom", "Mary", "12", "5", "3 km", "7%", "apples", "and", "to",
             "\ue001", "20 kg", "1,5", "Ann-Lee", "the"]
    items = [(i, " ".join(pick.choices(words, k=pick.randint(1, 30)))) for i in range(40)]
    docs = []
    for i in range(150):
        own = " ".join(pick.choices(words, k=pick.randint(0, 20)))
        text = pick.choice(items)[1]
        if pick.random() < 0.6:
            old, new = pick.sample(["12", "5", "Tom", "Mary", "3 km", "7%"], 2)
            text = text.replace(old, new)
        docs.append((i, f"{own} {text}. {own}"))
    assert check(spark, docs, items)


def test_a_text_of_many_numbers(spark):
    text = " ".join(f"{i} and {i + 1} apples" for i in range(25_000))
    items = [(1, "x 7 and 8 apples 8 and 9 apples 9 and 10 apples")]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = dc.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 1)]


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    found = dc.contaminated(odd_docs, items)
    assert {r.doc_id for r in found.collect()} == {1, 2, 8, None}
    left = dc.remove_contaminated(odd_docs, items)
    assert left.columns == odd_docs.columns
    assert {r.doc_id for r in left.collect()} == {3, 4, 5, 6, 7, 9, 10, None}
    assert dc.contaminated(no_docs, items).count() == 0
    assert dc.contaminated(odd_docs, items.limit(0)).count() == 0


def test_only_built_in_functions(docs, spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = dc.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_large_benchmarks_shuffle(docs, spark, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    few = sorted(tuple(r) for r in dc.contaminated(docs, items).collect())
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert sorted(tuple(r) for r in dc.contaminated(docs, items).collect()) == few
