from tideline.functions.digests import canonical_text, fingerprint, row_hash, sum_fingerprints
from tideline.functions.times import bucket_start, from_micros, micros, micros_of

__all__ = ["bucket_start", "canonical_text", "fingerprint", "from_micros", "micros",
           "micros_of", "row_hash", "sum_fingerprints"]
