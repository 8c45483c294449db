import itertools
import math

from pyspark.sql import functions as F

from gapline.llm import decontaminate as dec

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa"


def brute(docs, items, window=dec.WINDOW, agree=dec.AGREE):
    """Every diagonal of every pair, without seeds."""
    import math

    out = set()
    for item_id, item in items:
        w = (item or "").lower().split()
        if not w:
            continue
        size = min(window, len(w))
        for doc_id, text in docs:
            t = (text or "").lower().split()
            for start in range(-len(w) + 1, len(t)):
                same = [0 <= start + k < len(t) and t[start + k] == x for k, x in enumerate(w)]
                if max(sum(same[k : k + size]) for k in range(len(w) - size + 1)) >= math.ceil(size * (agree if len(w) >= 9 else 1)):
                    out.add((str(doc_id), item_id, start))
    return out


def shown(df):
    return {(str(r["doc_id"]), r["item_id"], r["start"]) for r in df.collect()}


def frames(spark, docs, items):
    extra = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("w", F.lit(1))
    return extra, spark.createDataFrame(items, "item_id long, text string").withColumn("start", F.lit(0))


def test_exact_and_changed_passages(spark):
    words = ITEM.split()
    changed = words.copy()
    changed[7] = "other"
    twice = words.copy()
    twice[3], twice[12] = "x", "y"
    docs = [(1, "some text " + ITEM + " more"), (2, "pre " + " ".join(changed)), (3, " ".join(twice)), (4, "nothing to see here at all my friend of old"), (5, ITEM.upper().replace(" ", " \n")), (6, " ".join(words[:14])), (7, " ".join(reversed(words)))]
    docs, items = frames(spark, docs, [(1, ITEM), (1, ITEM)])
    got = shown(dec.contaminated(docs, items))
    assert {d for d, _, _ in got} == {"1", "2", "3", "5", "6"}
    assert got == brute([tuple(r)[:2] for r in docs.collect()], [(1, ITEM)])
    assert shown(dec.contaminated(docs, items, broadcast_rows=0)) == got
    assert sorted(r["doc_id"] for r in dec.decontaminate(docs, items).collect()) == [4, 7]


def test_edges(spark):
    docs = [(1, None), (2, ""), (None, ITEM), (3, "one two three four five six"), (3, "one two three four five six"), (4, "w " * 60_000 + ITEM)]
    items = [(1, ITEM), (2, "two three four five six"), (3, "one two"), (4, None), (5, " ")]
    d, b = frames(spark, docs, items)
    want = {("None", 1, 0), ("3", 2, 1), ("4", 1, 60_000)}
    assert shown(dec.contaminated(d, b, least_words=5)) == want
    # All items without the bound; with and without the bitmap.
    every = want | {("3", 3, 0)}
    assert shown(dec.contaminated(d, b)) == shown(dec.contaminated(d, b, broadcast_rows=0)) == every
    assert dec.contaminated(d.limit(0), b).count() == 0 == dec.contaminated(d, b.limit(0)).count()
    assert dec.decontaminate(d, b).columns == d.columns and dec.decontaminate(d, b).count() == 2


def test_planted_leaks(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [(r["doc_id"], " ".join(r["text"].lower().split())) for r in docs.collect()]
    want = {(str(d), b["item_id"]) for b in items.collect() for d, t in texts if " ".join(b["text"].lower().split()) in t}
    got = {(d, i) for d, i, _ in shown(dec.contaminated(docs, items))}
    assert want and want <= got and len(got) <= len(want) + 2


def test_every_pattern_within_the_tolerance_is_found(spark):
    docs, items, want = [], [], set()
    for n in [*range(1, 14), 16]:
        item = [f"n{n}w{k}" for k in range(n)]
        size = min(dec.WINDOW, n)
        need = math.ceil(size * dec.AGREE)
        items.append((n, " ".join(item)))
        for differ in range(n - need + 2):
            for places in itertools.combinations(range(n), differ):
                laid = ["x" if k in places else w for k, w in enumerate(item)]
                same = [k not in places for k in range(n)]
                docs.append((len(docs), "before it " + " ".join(laid)))
                if max(sum(same[k : k + size]) for k in range(n - size + 1)) >= need:
                    want.add((str(len(docs) - 1), n, 2))
        docs += [(len(docs), " ".join(item[n - need :])), (len(docs) + 1, " ".join(item[:need]))]
        want |= {(str(len(docs) - 2), n, need - n), (str(len(docs) - 1), n, 0)}
    assert shown(dec.contaminated(*frames(spark, docs, items), broadcast_rows=0)) == want
    assert shown(dec.contaminated(*frames(spark, docs, items))) == want
    assert all(dec.covers(m, n, n - math.ceil(n * dec.AGREE)) for n, m in dec.MASKS.items())
    assert dec.masks_for(20, 0.5) == ("1",) and dec.masks_for(13, 1.0) == dec.MASKS[13]
