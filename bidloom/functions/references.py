"""Reply references: the token an invitation carries and a reply quotes back."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions.common import as_col, blank_to_null

TOKEN_PATTERN = r"(?i)\bRFX-[A-Z0-9]{2,10}-[A-Z0-9]{2,8}-[0-9a-f]{4,16}\b"


def reference_slug(text: Column, length: int) -> Column:
    """The legible part of a token, short by rule; the checksum, over the whole name, tells equal ones apart."""
    cleaned = F.substring(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9]+", ""), 1, length)
    return F.when(cleaned != "", cleaned).otherwise(F.lit("X"))


def checksum_digits(invitations: int) -> int:
    """Digits that keep the expected number of chance collisions among so many invitations below one; four up to 256."""
    return 4 + max(0, math.ceil(2 * math.log(max(invitations, 1) / 256.0) / math.log(16)))


def reply_token(reference: Column, title: Column, supplier: Column, line_count: Column, digits: int = 4) -> Column:
    """RFX-<request>-<supplier>-<checksum over the supplier's full name>."""
    request = reference_slug(F.coalesce(blank_to_null(reference), blank_to_null(title), F.lit("REQ")), 10)
    basis = F.concat_ws("|", request, F.lower(F.trim(F.coalesce(supplier, F.lit("")))), line_count.cast("string"))
    digest = F.substring(F.sha1(F.encode(basis, "UTF-8")), 1, digits)
    return F.concat_ws("-", F.lit("RFX"), request, reference_slug(supplier, 6), digest)


def quoted_token(text: Column | str) -> Column:
    """The first reference a text carries, upper-cased; NULL when it carries none."""
    return F.upper(blank_to_null(F.regexp_extract(as_col(text), TOKEN_PATTERN, 0)))
