"""Readers that turn raw source layouts into addressed tables."""
