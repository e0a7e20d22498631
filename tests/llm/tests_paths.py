"""Where the tokenizer files are."""

from public_tokenizers import path as tokenizer_path  # noqa: F401
