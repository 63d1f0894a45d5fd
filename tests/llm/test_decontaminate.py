import random
import re

from stockflow.llm import decontaminate as dc


def nearest(item, text):
    """Least edit distance of item to any stretch of text, by the whole table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        before, row[0] = row[0], 0
        for j, x in enumerate(item, 1):
            before, row[j] = row[j], before if x == c else 1 + min(row[j], row[j - 1], before)
        best = min(best, row[-1])
    return best


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.4:
            chars[at] = rng.choice("abc xyz")
        elif kind < 0.7:
            chars.insert(at, rng.choice("abc xyz"))
        else:
            del chars[at]
    return "".join(chars)


def cases():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(4, 14))) for i in range(25)] + [(90, None), (91, ""), (92, "short"), (95, "z"), (96, " Ab\n"), (97, "two  words"), (98, "nineteen characters"), (99, "eleven char"), (93, "a" * 30), (94, "ab" * 15)]
    docs = []
    for i in range(70):
        body = [say(rng.randint(0, 30))]
        if i % 2:
            _, item = items[i % 25]
            body.append(edited(rng, item, rng.randint(0, int(len(item) * dc.RATE) + 3)))
        body.append(say(rng.randint(0, 30)))
        docs.append((i, rng.choice([" ", "\n\t ", "  "]).join(body).upper() if i % 7 == 0 else " ".join(body)))
    docs += [(110, "a SHORT tale"), (111, "shorter tales"), (112, "(two words)"), (113, "xtwo words"), (114, "nineteen  characters"), (115, "ab"), (116, "cab abc"), (117, "eleven char.")]
    docs += [(100, None), (101, ""), (102, "a" * 5000), (103, "z " * 4000 + items[3][1]), (104, items[4][1]), (None, items[5][1])]
    return docs, items


def test_against_the_whole_table(spark):
    docs, items = cases()
    table = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    for block in (10**6, 150):
        got = {(r.doc_id, r.item_id): r.distance for r in dc.leaks(table, benchmark, block_chars=block).collect()}
        want = {}
        for d, text in docs:
            for i, item in items:
                item = dc.plain(item)
                if len(item) >= dc.SHORTEST:
                    n = nearest(item, dc.plain(text))
                    if n <= dc.budget_of(item, dc.RATE):
                        want[d, i] = n
                elif item and re.search(rf"(?<!\w){re.escape(item)}(?!\w)", dc.plain(text)):
                    want[d, i] = 0
        assert got == want and len(want) > 15
    assert {len(dc.plain(t)) for i, t in items if any(k[1] == i for k in want)} & {1, 2, 5, 11, 19}
    benchmark = benchmark.unionByName(spark.createDataFrame([(999, "  o  " + " " * 40, 1)], "item_id long, text string, doc_id int"))  # one character, however long it is as it stands
    short = {d for d, text in docs if re.search(r"(?<!\w)o(?!\w)", dc.plain(text))}
    for least, also in ((1, short), (20, set())):
        gone = {d for d, i in want if len(dc.plain(dict(items)[i])) >= least} | also
        left = dc.without_leaks(table, benchmark, least=least)
        assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - gone


def test_empty_tables(spark):
    docs, items = cases()
    table, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.leaks(table.where("false"), benchmark).count() == 0 and dc.leaks(table, benchmark.where("false")).count() == 0
    assert dc.without_leaks(table, benchmark.where("false")).count() == len(docs)


def test_query(spark, sf):
    got = {(r.doc_id, r.item_id) for r in dc.op8_decontaminate(spark, sf).collect()}
    items = [(r.item_id, dc.plain(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = {(r.doc_id, i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, t in items if len(t) >= dc.SHORTEST and t in dc.plain(r.text)}
    assert exact <= got
