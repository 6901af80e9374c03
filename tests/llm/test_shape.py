from marlstone.llm import pii


def test_shape_reads_the_whole_word():
    assert pii.shape("a" * 100 + "@1") == "x@d"
    assert pii.shape("a1" * 50 + "-") == "xd" * 50 + "-"
