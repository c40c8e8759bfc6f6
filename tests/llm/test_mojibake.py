from lodestrata.llm import mojibake as M


def test_units():
    assert M.split_run("Ã©") == ("Ã©",) and M.split_run("’é") == ("’", "é")
    assert M.split_run("â€™Ã©") == ("â€™", "Ã©") and M.split_run("ÃƒÂ©") == ("ÃƒÂ©",)
    assert dict(M.decodings("Ã©"))["utf8>cp1252"] == "é" and dict(M.decodings("ÃƒÂ©"))["utf8>cp1252>utf8>cp1252"] == "é"
    assert dict(M.decodings("Θ"))["cp1252>cp437"] == "é" and dict(M.decodings("â\x80\x99"))["utf8>cp1252"] == "’"
    assert dict(M.decodings("é"))[""] == "é"


CLEAN = "L’été, le référent a complété la pièce jointe après l’échéance. Übersicht für Prüfgremium, größer als zuvor. La revisión técnica está señalada."


def test_found_and_repaired(spark):
    rows = [(i, CLEAN, "s") for i in range(60)]
    rows += [(100, CLEAN.encode().decode("cp1252", "replace") if False else "Le rÃ©fÃ©rent a complÃ©tÃ© la piÃ¨ce", "s"), (101, CLEAN.encode("cp1252").decode("cp437"), "s"), (102, "la r�vision", "s"), (103, None, "s"), (104, "", None), (105, "“Ãmbar” Coração ÂGE", None), (106, "附件 Приложение журналу ملحق", "s"), (107, "plain", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in M.found(docs).collect()} == {100, 101, 102}
    texts = {r.doc_id: r.text for r in M.repaired(docs).collect()}
    assert texts[100] == "Le référent a complété la pièce" and texts[101] == CLEAN and texts[0] == CLEAN and texts[103] is None and texts[105] == rows[-3][1]


def test_other_scripts(spark):
    texts = ["यह नीति सभी कर्मचारियों पर लागू होती है", "นโยบายนี้ใช้กับพนักงานทุกคน", "այս կանոնը վերաբերում է բոլորին", "ეს წესი ყველას ეხება", "本政策适用于所有员工"]
    rows = [(10 * i + j, t, "s") for i, t in enumerate(texts) for j in range(5)]
    rows += [(100 + i, "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t.encode()), "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in M.found(docs).collect()} == {100, 101, 102, 103, 104}
    assert {r.doc_id: r.text for r in M.repaired(docs).collect() if r.doc_id >= 100} == {100 + i: t for i, t in enumerate(texts)}


def test_long_runs_are_not_kept():
    M._known_run.cache_clear()
    M.units_of("附件三应每年审查一次不得外传" * 50)
    assert M._known_run.cache_info().currsize == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert M.found(docs).count() == 0 and M.repaired(docs).count() == 0
