"""Dataflow operators on points, hash parameters, buckets, candidates and neighbours."""
