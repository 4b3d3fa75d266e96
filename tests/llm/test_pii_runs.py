import time

from plumbline.llm import pii


def phones(text):
    return {text[a:b] for a, b, kind, _ in pii.candidates(text, pii.Names({"robin"}, {"reed"}, {})) if kind == "phone"}


def test_phones_in_long_runs_are_proposed():
    for row in ("12 40 7 " * 30, "1-2-3-4-5-6-7-8-9-10-11-12-13 ", "1000 2000 3000 4000 5000 6000 7000 8000 9000 1000 1100 "):
        for phone in ("555 010 4477", "+49 30 9018 2044", "5 5 5 0 1 0 4 4 7 7"):
            assert phone in phones(f"see {row}{phone} today"), (row, phone)


def test_long_runs_stay_linear():
    text = "12 40 7 " * 2000
    began = time.process_time()
    phones(text)
    assert time.process_time() - began < 10
