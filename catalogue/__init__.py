"""Named queries over the driver tables, their inputs and their oracles."""
