"""Named query plans over the star-schema tables, each with its SQL twin."""
