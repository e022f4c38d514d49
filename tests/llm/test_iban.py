"""One IBAN behind another."""

from tidewatch.llm import pii


def test_an_iban_behind_another_is_found():
    two = ["DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"]
    text = f"Our IBAN: {two[0]} {two[1]} for payments to the bank"
    spans = [text[a:b] for a, k, b in pii.more_spans(text, []) if pii.KINDS[k] == "iban"]
    assert spans == two
    masked = pii._masked([text])[0]
    assert masked == "Our IBAN: <IBAN> <IBAN> for payments to the bank"
