import random
import zlib

from lexmill.llm import toxicity
from lexmill.llm.common import crc_mod


def test_all_of_a_long_run_counts():
    run = "".join(chr(0x4E00 + i) for i in range(1000))
    got = toxicity.words_of(f"ab {run} cd".encode())
    assert got[0] == "ab" and got[-1] == "cd" and max(map(len, got)) <= 64
    assert all(any(run[i : i + 16] in w for w in got) for i in range(len(run) - 15))
    for n in (1, 63, 64, 65, 112, 113):
        assert "".join(toxicity.words_of(run[:n].encode()))[-1] == run[n - 1]

    def joined(words):
        return "_".join(["lorem", "ipsum", "dolor", "sit", "amet", "elit"] * 4 + words).encode()

    sample = [(f"text number {i} is fine and plain".encode(), 0) for i in range(40)] + [(f"text number {i} is idiot moron trash".encode(), 1) for i in range(40)]
    model = toxicity.train(sample)
    scores = toxicity._Scores(model)
    assert toxicity.logit(model, joined(["idiot", "moron", "trash"]), scores) > toxicity.logit(model, joined(["fine", "and", "plain"]), scores) + 0.1


def test_held_out_recall_and_unseen_misspellings(spark):
    """0.9 of the held-out toxic texts of the table are caught, 0.02 of the clean ones lost at most."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "lang", "toxic").orderBy("doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 5) != 0)
    scores = toxicity._Scores(model)

    def caught(texts):
        return sum(toxicity.logit(model, t.encode(), scores) >= 0 for t in texts) / len(texts)

    rnd = random.Random(3)
    insults = "trash pathetic idiot worthless disgusting stupid clown scum loser moron".split()
    known = {w for r in rows for w in toxicity.words_of(r.text.encode())}
    clean = [r.text.split(" ") for r in held if r.toxic == 0 and r.lang == "en" and 200 < len(r.text) < 1500 and toxicity.logit(model, r.text.encode(), scores) < 0][:60]
    misspelt = []
    for words in clean:
        for w in rnd.sample(insults, 3):
            at, c = rnd.randrange(1, len(w)), rnd.choice("0123456789abcdefghijklmnopqrstuvwxyz")
            odd = [w[:at] + c + w[at + 1 :], w[:at] + w[at] + w[at:], w[:at] + c + w[at:]][rnd.randrange(3)]
            if odd not in known:
                misspelt.append(" ".join([*words[: len(words) // 2], odd, *words[len(words) // 2 :]]))
    got = {"toxic": caught([r.text for r in held if r.toxic == 1]), "clean": caught([r.text for r in held if r.toxic == 0]), "misspelt": caught(misspelt)}
    print(got)
    assert got["toxic"] >= 0.9 and got["clean"] <= 0.02 and got["misspelt"] >= 0.4 and len(misspelt) > 100, got
