"""Dataflow operators over features, codes and graphs."""
