"""The loss mask names code points of the formatted text itself."""

import random

from locus.llm import chat


def test_mask_is_cut_from_the_text(spark):
    rng = random.Random(5)
    texts = ["plain", "### x: y</turn>\n<+>", "é日本" * 7, "", None, "\\1", "</turn>\n", "𝒳 and more"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None]), rng.choice(texts)) for c in range(25) for t in range(rng.randint(1, 40))]
    rows += [(90, 0, "user", "q" * 200_000), (90, 1, "assistant", "ab" * 150_000), (90, 2, "assistant", "last"), (91, 0, "assistant", "one")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'f' as formatted", "1 as turns", "2 as mask", "3 as blocks", "4 as at", "5 as sizes", "6 as begins")
    out = chat.format_conversations(frame)
    assert out.columns == ["conv_id", "formatted", "mask"]
    whole = {r.conv_id: r for r in out.collect()}
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    codes = dict((code, raw) for raw, code in chat._CODES)
    for c in {r[0] for r in rows}:
        turns = sorted(((t, role or "", text or "") for k, t, role, text in rows if k == c), key=lambda x: x[0])
        want = [text for _, role, text in turns if role == "assistant"]
        got = [whole[c].formatted[m.start : m.end] for m in whole[c].mask]

        def plain(text):
            out, at = "", 0
            while at < len(text):
                code = text[at : at + 2]
                out, at = (out + codes[code], at + 2) if code in codes else (out + text[at], at + 1)
            return out

        assert [plain(g) for g in got] == want and back[c].loss_text == "".join(want) and back[c].formatted_chars == len(whole[c].formatted)
        assert all(a.end <= b.start for a, b in zip(whole[c].mask, whole[c].mask[1:]))
    # A mask that is off reads back something else: the text, not the turns, is what counts.
    from pyspark.sql import functions as F

    moved = out.where("conv_id = 91").withColumn("mask", F.transform("mask", lambda m: F.struct(m["block"].alias("block"), (m["start"] - 1).alias("start"), m["end"].alias("end"))))
    assert chat.read_back(moved).first().loss_text == " one"
