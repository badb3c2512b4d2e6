"""Column functions: seeded uniforms, geometry, distance decay."""
