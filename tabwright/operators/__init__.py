"""Table operators: profile, validate, clean, encode, scale, analyse, select."""
