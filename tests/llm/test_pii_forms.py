"""Secrets in either case, and cards before other digits."""

from trackloom.llm import pii


def test_upper_case_secrets_and_cards_before_other_digits(spark):
    secret, number = "9233a8ec" * 4, "4111111111111111"
    texts = [f"token {secret}", f"TOKEN {secret.upper()}", f"card {number}", f"card {number} 12/25", f"card 4111 1111 1111 1111 12/25", f"card {number[:-1]}2 12/25", f"card {number[:-1]}2", f"token {secret[:8].upper()}{secret[8:]}"]
    out = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert out[1] != texts[1] and out[1][6:] == out[0][6:].upper() and out[7][6:].lower() == out[0][6:] and out[7] != texts[7]
    assert out[2] != texts[2] and out[3] == out[2] + " 12/25" and out[4].replace(" ", "") == out[3].replace(" ", "")
    assert out[6] != texts[6] and out[5] == out[6] + " 12/25"
