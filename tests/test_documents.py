"""Documents of annotation tools: well-formed, with every annotation, slots and tiers in order."""

import xml.etree.ElementTree as tree

from locus.sources import sidecars


def test_documents(spark, tmp_path):
    rows = [("r1", "speech", 1, 0.5, 2.25, 'a "b" <c> & d'), ("r1", "speech", 2, 0.1, 0.4, None), ("r1", "gaze", 3, 7.0, None, "left"), ("r2", None, 4, 1.0, 1.0, "x")]
    frame = spark.createDataFrame(rows, "recording string, tier string, id long, start_time double, end_time double, code string")
    sidecars.write_documents(sidecars.eaf_documents(frame), str(tmp_path / "eaf"))
    (file,) = (tmp_path / "eaf" / "recording=r1").glob("*.txt")
    root = tree.fromstring(file.read_text().split("?>", 1)[1])
    slots = {s.get("TIME_SLOT_ID"): int(s.get("TIME_VALUE")) for s in root.find("TIME_ORDER")}
    got = [(t.get("TIER_ID"), slots[a.get("TIME_SLOT_REF1")], slots[a.get("TIME_SLOT_REF2")], a.find("ANNOTATION_VALUE").text) for t in root.findall("TIER") for a in t.iter("ALIGNABLE_ANNOTATION")]
    assert got == [("gaze", 7000, 7000, "left"), ("speech", 100, 400, None), ("speech", 500, 2250, 'a "b" <c> & d')] and len(slots) == 6
    anvil = {r.recording: tree.fromstring(r.xml.split("?>", 1)[1]) for r in sidecars.anvil_documents(frame).collect()}
    assert [(t.get("name"), e.get("index"), e.get("start"), e.get("end")) for t in anvil["r1"].iter("track") for e in t.iter("el")] == [("gaze", "0", "7.000", "7.000"), ("speech", "0", "0.100", "0.400"), ("speech", "1", "0.500", "2.250")]
    assert set(anvil) == {"r1", "r2"} and sidecars.eaf_documents(frame.limit(0)).count() == 0
