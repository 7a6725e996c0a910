"""Words that are hard to tell apart."""


def thue_morse(size):
    """A word over two letters and its complement, which have equal polynomial hashes modulo 2**64."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(size))
    return word, word.translate({97: "b", 98: "a"})
