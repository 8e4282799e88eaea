"""A corpus of planted disguises: what share of them op3's second pass finds, and what it finds in clean prose."""

import random

from locus.llm import pii


def planted(rng, prose):
    """A text with one identifier in a disguise, and the kind and place of it."""
    name, host = rng.choice(["john.smith", "ana_lopez", "m.weber42", "kim"]), rng.choice(["example.com", "mail.example.org", "uni-x.net"])
    card = [rng.randrange(10) for _ in range(15)]
    card += [next(d for d in range(10) if pii._luhn("".join(map(str, card)) + str(d)))]
    words = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    digits = "".join(map(str, card))
    phone = "+" + str(rng.randrange(1, 9)) + "".join(str(rng.randrange(10)) for _ in range(10))
    ip = [rng.randrange(256) for _ in range(4)]
    made = {
        "brackets": ("email", f"{name} [at] {host.replace('.', ' [dot] ')}"),
        "words": ("email", f"{name} at {host.replace('.', ' dot ')}"),
        "lookalikes": ("email", f"{name}@{host}".replace("o", "о").replace("e", "е")),
        "invisible": ("email", "​".join(f"{name}@{host}")),
        "full width": ("card", "".join(chr(0xFF10 + int(d)) for d in digits)),
        "spelled card": ("card", " ".join(words[int(d)] for d in digits)),
        "half spelled": ("card", f"{digits[:4]} {digits[4:8]} {digits[8:12]} " + " ".join(words[int(d)] for d in digits[12:])),
        "spelled phone": ("phone", "plus " + " ".join(words[int(d)] for d in phone[1:])),
        "spelled ip": ("ip", " dot ".join(" ".join(words[int(d)] for d in str(p)) for p in ip)),
        "odd dots": ("ip", "․".join(map(str, ip))),
    }
    form = rng.choice(sorted(made))
    kind, text = made[form]
    lead = f"{prose()} ("
    return form, kind, lead + text + f") {prose()}", (len(lead), len(lead) + len(text))


def test_recall_and_false_hits():
    rng = random.Random(12)
    vocab = "the of a meeting at one house two days dot matrix report for you and three more years later it was four people who came".split()
    prose = lambda: " ".join(rng.choices(vocab, k=rng.randint(5, 25)))
    found, total = {}, {}
    for _ in range(600):
        form, kind, text, (a, b) = planted(rng, prose)
        total[form] = total.get(form, 0) + 1
        spans = pii.find_all(text)[1][kind]
        found[form] = found.get(form, 0) + any(s <= a + 1 and e >= b - 1 and e - s <= b - a + 12 for s, e in spans)
    shares = {k: found[k] / total[k] for k in total}
    assert all(v >= 0.9 for v in shares.values()), shares
    hits = sum(any(pii.find_all(prose())[1].values()) for _ in range(2000))
    # Prose in which every twentieth word is "at" or "dot" now and then spells an address; without "dot" it does not.
    assert hits <= 60, hits
    vocab.remove("dot")
    rare = sum(any(pii.find_all(prose())[1].values()) for _ in range(2000))
    assert rare == 0, rare
    print("recall", sum(found.values()) / 600, "false hits", hits / 2000, shares)
