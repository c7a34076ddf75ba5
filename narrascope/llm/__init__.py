"""Operations for large training-data corpora. Nothing outside this subpackage imports it."""
