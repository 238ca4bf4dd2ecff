"""Column-level helpers (all JVM-side built-ins, safe inside codegen)."""

from voxlex.functions.scalar import (
    to_frame, nan_to_null, nan_to_zero, subject_code, replace_token,
    masked_value, signed_root, hash_unit, tokens,
)

__all__ = [
    "to_frame", "nan_to_null", "nan_to_zero", "subject_code", "replace_token",
    "masked_value", "signed_root", "hash_unit", "tokens",
]
