import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import subwords
from chronoloom.functions import text as tx
from chronoloom.operators import compose, windows

TEXTS = [None, "", " ", "hello world", "Ça va? 中文 🙂\n\n ok", "a" * 300, "x y\tz  \r\n"]


def plain(ranks, text):
    """Merges of the least rank, one by one, over pieces of the pattern."""
    import base64

    import regex

    order = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines())}
    out = []
    for piece in regex.findall(subwords.PATTERN, text or ""):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            least = min(range(len(parts) - 1), key=lambda i: order.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[least] + parts[least + 1] not in order:
                break
            parts[least : least + 2] = [parts[least] + parts[least + 1]]
        out += [order[p] for p in parts]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    more = ["".join(rng.choice("abc deé\n.,'s12 ") for _ in range(rng.randrange(60))) for _ in range(60)]
    return spark.createDataFrame(list(enumerate(TEXTS + more)), "k int, text string")


def test_ids_equal_plain_merges_and_give_texts_back(rows):
    bpe = tx.tokenizer_named("bpe")
    for r in rows.select("text", bpe.ids(F.col("text")).alias("ids"), bpe.count(F.col("text")).alias("n")).withColumn("back", bpe.text(F.col("ids"))).collect():
        assert list(r.ids) == plain(bpe.ranks, r.text) and r.n == len(r.ids) and r.back == (r.text or "")


def test_last_tokens(spark):
    rows = spark.createDataFrame([("one two three four", 2), ("one", 5), ("one two", 0), (None, 3), ("x", None)], "t string, n int")
    assert [r[0] for r in rows.select(tx.last_tokens(F.col("t"), F.col("n"), "bpe")).collect()] == [" three four", "one", "", "", ""]


def test_counts_of_arrays(spark):
    rows = spark.createDataFrame([(["a b", None, ""],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in rows.select(tx.tokenizer_named("bpe").counts(F.col("x"))).collect()] == [[2, 0, 0], [], None]


def test_another_vocabulary_file(spark, tmp_path):
    import base64

    path = tmp_path / "small"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 256\n")
    tx.TOKENIZERS["small"] = subwords.Subwords(str(path))
    assert spark.range(1).select(tx.token_count(F.lit("abab c"), "small")).first()[0] == 4
    del tx.TOKENIZERS["small"]


def test_windows_and_prompts_by_subwords(spark):
    visit = lambda k: f'<visit start="0{k}/01/2020 10:00"><note>{"word " * k}</note></visit>'
    timelines = spark.createDataFrame([(1, "<ehr>" + "".join(map(visit, range(1, 7))) + "</ehr>")], "person_id long, text string")
    ranks = tx.tokenizer_named("bpe").ranks
    sizes = [len(plain(ranks, visit(k))) for k in range(6, 0, -1)]
    budget = sizes[0] + sizes[1]
    packed = windows.pack_windows(compose.timeline_visits(timelines), budget, 0.0, tokenizer="bpe").orderBy("window_index").collect()
    assert packed[0].visit_tokens == budget and packed[0].tokens == len(plain(ranks, f"<patient>\n{visit(6)}\n{visit(5)}\n</patient>"))
    assert sum(r.visits for r in packed) == 6
    asked = spark.createDataFrame([(9, 1, "what now")], "instruction_id long, person_id long, instruction string")
    template = "{ehr}|{question}"
    room = 40
    context = compose.GENERATION + len(plain(ranks, template)) + len(plain(ranks, "what now")) + room
    prompt = compose.pack_prompts(asked, timelines, template, context, tokenizer="bpe", first="whitespace").first().prompt
    kept = prompt.removesuffix("|what now")
    assert visit(6).endswith(kept[-20:]) and len(plain(ranks, kept)) <= room + 1


def test_very_long_runs_of_blanks():
    bpe = tx.tokenizer_named("bpe")
    own = subwords.encoder(bpe.ranks, bpe.pattern)
    for run in (" " * 1_300_000, "\n" * 1_300_000, " \n" * 60_000):
        text = "a " + run + "b c"
        assert own.decode(subwords.encode(own, bpe.pattern, text)) == text
    short = "a " + " \n " * 400 + "b"
    import regex

    assert own.encode_ordinary(short) == [i for p in regex.findall(bpe.pattern, short) for i in own._encode_single_piece(p)]
