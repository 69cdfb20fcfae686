"""No streams: features need a series' past, standardisation and clusters all of it, so every
analysis here is a batch over complete bars."""
