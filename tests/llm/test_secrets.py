from tidewatch.llm import pii
from tidewatch.llm.queries import op1_pii


def added(text):
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.more_spans(text, pii.base_spans(text))]


def test_context_decides_on_keys():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert added(f'x token = "{key}" y') == [("secret", key)] and added(f"API_KEY: {key}==") == [("secret", f"{key}==")]
    assert added(f"a word {key} without context") == [] and added(f"token of commit {key}") == []  # a word against it
    assert added("password: aaaaaaaaaaaaaaaaaaaaaaaa1") == [] and added("password " + "abcdefghij" * 3) == []
    assert pii._masked([f"secret {key}."]) == ["secret <SECRET>."]


def test_paths_and_urls_are_no_keys():
    key = "a1b2c3d4e5f6a7b8c9d0e1f2a3"
    for text in (
        f"The access key is https://example.com/files/{key}", f"token: https://example.com/{key}?x", f"secret www.example.com/{key}", "password reset link /users/2024/reports/final-version-9b",
        "password in users/2024/reports/final-version-9b", f"token ./build/{key}", f"password {key}/index/page1", f"api key at https://example.com/?q=x/{key}",
    ):
        assert added(text) == [], text
    assert added("secret wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY") == [("secret", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")]
    assert added(f"token={key}") == [("secret", key)] and added(f'"token":"{key}"') == [("secret", key)]
    long = "password " + "x" * 3000 + f" {key}"
    assert added(long) == []  # no word for it near by


def test_the_method_adds_spans_and_keeps_the_base(spark, tmp_path):
    text = 'mail a.b@c.de, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op1_pii(spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:5:13,secret:24:64" and got[1].n_email == 1 and got[1].n_spans == 2
    assert (got[2].spans, got[2].n_spans) == ("", 0) == (got[3].spans, got[3].n_spans)
