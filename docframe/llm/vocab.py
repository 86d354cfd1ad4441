"""Places of public vocabulary files."""


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a vocabulary file of the public_tokenizers package, which every executor has."""
    import public_tokenizers

    return public_tokenizers.path(name)
