"""Definitions of maps and grids and points on them that other software has computed: fixed values, in its own formats."""

#: Kind of file and its lines, by name.
DEFINITIONS = {
    "M200correct": ("mpp", """\
Cylindrical Equal-Area
0.0 0.0 30.0
0.0
200.5402
00.00 00.00
-90.00 90.00
-180.00 180.00
30.00 30.00
00.00 00.00
1 0 0
"""),
    "Ml": ("gpd", """\
M200correct.mpp
1383 586
8
691.0 292.5
"""),
    "N200correct": ("mpp", """\
Azimuthal Equal-Area
90.0 0.0
0.0
200.5402
90.00 00.00
0.00 90.00
-180.00 180.00
15.00 30.00
0.00 00.00
1 0 0
"""),
    "N3B": ("gpd", """\
Nps.mpp
304 448
4
153.5 233.5
"""),
    "Na25": ("gpd", """\
N200correct.mpp
361 361
8
180.0 180.0
"""),
    "Nps": ("mpp", """\
Polar Stereographic Ellipsoid
90.0 -45.0 70.0
0.0
100.0
90.00 135.00
20.00 90.00
-180.00 180.00
10.00 15.00
00.00 00.00
1 0 0
6378.273
0.081816153
"""),
    "S200correct": ("mpp", """\
Azimuthal Equal-Area
-90.0 0.0
0.0
200.5402
-90.00 00.00
-90.00 0.00
-180.00 180.00
15.00 30.00
0.00 00.00
1 0 0
"""),
    "S3B": ("gpd", """\
Sps.mpp
316 332
4
157.5 173.5
"""),
    "Sa25": ("gpd", """\
S200correct.mpp
321 321
8
160.0 160.0
"""),
    "Sps": ("mpp", """\
Polar Stereographic ellipsoid
-90.0 0.0 -70.0
0.0
100.0
-90.00 0.00
-90.00 -20.00
-180.00 180.00
10.00 15.00
0.00 0.00
1 0 0
6378.273
0.081816153
"""),
    "albers_conic_equal_area_e00": ("gpd", """\
Map Projection: Albers Conic Equal-Area Ellipsoid
Map Equatorial Radius: 6378206.4
Map Eccentricity: 0.0822719
Map Reference Latitude: 29.5
Map Second Reference Latitude: 45.5
Map Origin Latitude: 23.0
Map Reference Longitude: -96.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 15000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "albers_conic_equal_area_e01": ("gpd", """\
Map Projection: Albers Conic Equal-Area Ellipsoid
Map Equatorial Radius: 6378206.4
Map Eccentricity: 0.0822719
Map Reference Latitude: -45.5
Map Second Reference Latitude: -29.5
Map Origin Latitude: -23.0
Map Reference Longitude: 96.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 15000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "albers_conic_equal_area_s00": ("gpd", """\
Map Projection: Albers Conic Equal-Area
Map Equatorial Radius: 1.0
Map Reference Latitude: 29.5
Map Second Reference Latitude: 45.5
Map Origin Latitude: 23.0
Map Reference Longitude: -96.0
Grid Width: 300
Grid Height: 300
Grid Cells Per Map Unit: 500
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "albers_conic_equal_area_s01": ("gpd", """\
Map Projection: Albers Conic Equal-Area
Map Equatorial Radius: 1.0
Map Reference Latitude: -45.5
Map Second Reference Latitude: -29.5
Map Origin Latitude: -23.0
Map Reference Longitude: 96.0
Grid Width: 300
Grid Height: 300
Grid Cells Per Map Unit: 500
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "azimuthal_equal_area_e00": ("gpd", """\
Map Projection: Azimuthal Equal-Area Ellipsoid
Map Equatorial Radius: 6378206.4
Map Eccentricity: 0.0822719
Map Reference Latitude: 40.0
Map Reference Longitude: -100.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 15000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "azimuthal_equal_area_e01": ("gpd", """\
Map Projection: Azimuthal Equal-Area Ellipsoid
Map Equatorial Radius: 6378388.0
Map Eccentricity: 0.0819919
Map Reference Latitude: 90.0
Map Reference Longitude: -100.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 15000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "azimuthal_equal_area_e02": ("gpd", """\
Map Projection: Azimuthal Equal-Area Ellipsoid
Map Equatorial Radius: 6378206.4
Map Eccentricity: 0.0822719
Map Reference Latitude: -40.0
Map Reference Longitude: 100.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 15000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "azimuthal_equal_area_e03": ("gpd", """\
Map Projection: Azimuthal Equal-Area Ellipsoid
Map Equatorial Radius: 6378388.0
Map Eccentricity: 0.0819919
Map Reference Latitude: -90.0
Map Reference Longitude: 100.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 15000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "azimuthal_equal_area_s00": ("gpd", """\
Map Projection: Azimuthal Equal-Area
Map Equatorial Radius: 3.0
Map Reference Latitude: 40.0
Map Reference Longitude: -100.0
Grid Width: 300
Grid Height: 300
Grid Cells Per Map Unit: 70
Grid Map Origin Column: 299.5
Grid Map Origin Row: 299.5
"""),
    "cylindrical_equal_area_e00": ("gpd", """\
Map Projection: Cylindrical Equal-Area Ellipsoid
Map Equatorial Radius: 6378206.4
Map Eccentricity: 0.0822719
Map Reference Latitude: 0.0
Map Reference Longitude: -75.0
Map Second Reference Latitude: 5.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 15000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "cylindrical_equal_area_s00": ("gpd", """\
Map Projection: Cylindrical Equal-Area
Map Equatorial Radius: 1.0
Map Reference Latitude: 0.0
Map Reference Longitude: -75.0
Grid Width: 500
Grid Height: 200
Grid Cells Per Map Unit: 100
Grid Map Origin Column: 249.5
Grid Map Origin Row: 99.5
"""),
    "cylindrical_equidistant_s00": ("gpd", """\
Map Projection: Cylindrical Equidistant
Map Equatorial Radius: 57.2957795130823
Map Reference Latitude: 0.0
Map Reference Longitude: 0.0
Grid Width: 360
Grid Height: 180
Grid Map Units per Cell: 1.0
Grid Map Origin Column: 179.5
Grid Map Origin Row: 89.5
"""),
    "homolosine_s00": ("gpd", """\
Map Projection: Interrupted Homolosine
Map Equatorial Radius: 6370997.0
Map Reference Latitude: 0.0
Map Reference Longitude: 0.0
Grid Width: 500
Grid Height: 200
Grid Map Units Per Cell: 5000
Grid Map Origin Column: 2599.5
Grid Map Origin Row: 999.5
"""),
    "integerized_sinusoidal_s00": ("gpd", """\
Map Projection: Integerized Sinusoidal
Grid Width: 500
Grid Height: 200
Grid Map Units Per Cell: 5000
Grid Map Origin Column: 1999.5
Grid Map Origin Row: 999.5
"""),
    "lambert_conic_conformal_e00": ("gpd", """\
Map Projection: Lambert Conic Conformal Ellipsoid
Map Equatorial Radius: 6378206.4
Map Eccentricity: 0.0822719
Map Reference Latitude: 33.0
Map Second Reference Latitude: 45.0
Map Origin Latitude: 23.0
Map Reference Longitude: -96.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 15000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "lambert_conic_conformal_e01": ("gpd", """\
Map Projection: Lambert Conic Conformal Ellipsoid
Map Equatorial Radius: 6378206.4
Map Eccentricity: 0.0822719
Map Reference Latitude: -45.0
Map Second Reference Latitude: -33.0
Map Origin Latitude: -23.0
Map Reference Longitude: 96.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 15000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "mercator_s00": ("gpd", """\
Map Projection: Mercator
Map Equatorial Radius: 1.0
Map Reference Latitude: 0.0
Map Reference Longitude: -180.0
Grid Width: 500
Grid Height: 200
Grid Cells Per Map Unit: 100
Grid Map Origin Column: 249.5
Grid Map Origin Row: 99.5
"""),
    "mollweide_s00": ("gpd", """\
Map Projection: Mollweide
Map Equatorial Radius: 1.0
Map Reference Latitude: 0.0
Map Reference Longitude: -90.0
Grid Width: 500
Grid Height: 200
Grid Cells Per Map Unit: 125
Grid Map Origin Column: 249.5
Grid Map Origin Row: 79.5
"""),
    "orthographic_s00": ("gpd", """\
Map Projection: Orthographic
Map Equatorial Radius: 1.0
Map Reference Latitude: 40.0
Map Reference Longitude: -100.0
Grid Width: 300
Grid Height: 300
Grid Cells Per Map Unit: 500
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "polar_stereographic_e00": ("gpd", """\
Map Projection: Polar Stereographic Ellipsoid
Map Equatorial Radius: 6378388.0
Map Eccentricity: 0.0819919
Map Reference Latitude: -90.0
Map Second Reference Latitude: -71.0
Map Reference Longitude: -100.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 15000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "polar_stereographic_e01": ("gpd", """\
Map Projection: Polar Stereographic Ellipsoid
Map Equatorial Radius: 6378388.0
Map Eccentricity: 0.0819919
Map Reference Latitude: 90.0
Map Second Reference Latitude: 71.0
Map Reference Longitude: 100.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 15000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "polar_stereographic_s00": ("gpd", """\
Map Projection: Polar Stereographic
Map Equatorial Radius: 1.0
Map Reference Latitude: -90.0
Map Second Reference Latitude: -71.0
Map Reference Longitude: -100.0
Grid Width: 300
Grid Height: 300
Grid Cells Per Map Unit: 500
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "polar_stereographic_s01": ("gpd", """\
Map Projection: Polar Stereographic
Map Equatorial Radius: 1.0
Map Reference Latitude: 90.0
Map Second Reference Latitude: 71.0
Map Reference Longitude: 100.0
Grid Width: 300
Grid Height: 300
Grid Cells Per Map Unit: 500
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "sinusoidal_s00": ("gpd", """\
Map Projection: Sinusoidal
Map Equatorial Radius: 1.0
Map Reference Latitude: 0.0
Map Reference Longitude: -90.0
Grid Width: 500
Grid Height: 250
Grid Cells Per Map Unit: 135
Grid Map Origin Column: 249.5
Grid Map Origin Row: 124.5
"""),
    "sinusoidal_s01": ("gpd", """\
Map Projection: Sinusoidal
Map Equatorial Radius: 1.0
Map Reference Latitude: 0.0
Map Reference Longitude: 90.0
Grid Width: 500
Grid Height: 250
Grid Cells Per Map Unit: 135
Grid Map Origin Column: 249.5
Grid Map Origin Row: 124.5
"""),
    "transverse_mercator_e00": ("gpd", """\
Map Projection: Transverse Mercator Ellipsoid
Map Equatorial Radius: 6378206.4
Map Eccentricity Squared: 0.00676866
Map Reference Latitude: 0.0
Map Reference Longitude: -75.0
Map Center Scale: 0.9996
Map Maximum Error: 100.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 1000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 4499.5
"""),
    "transverse_mercator_e01": ("gpd", """\
Map Projection: Transverse Mercator Ellipsoid
Map Equatorial Radius: 6378206.4
Map Polar Radius: 6356583.8
Map Reference Latitude: 0.0
Map Reference Longitude: 75.0
Map Center Scale: 0.9996
Map Southern Bound: -50.0
Map Northern Bound: -30.0
Map Western Bound: 60.0
Map Eastern Bound: 90.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 1000
Grid Map Origin Column: 149.5
Grid Map Origin Row: -4199.5
"""),
    "transverse_mercator_s00": ("gpd", """\
Map Projection: Transverse Mercator
Map Equatorial Radius: 1.0
Map Reference Latitude: 0.0
Map Reference Longitude: -75.0
Map Center Scale: 1.0
Grid Width: 300
Grid Height: 300
Grid Cells Per Map Unit: 60
Grid Map Origin Column: 149.5
Grid Map Origin Row: 149.5
"""),
    "universal_transverse_mercator_e00": ("gpd", """\
Map Projection: Universal Transverse Mercator
Map Equatorial Radius: 6378206.4
Map Eccentricity Squared: 0.00676866
Map UTM Zone: 18
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 1000
Grid Map Origin Column: 149.5
Grid Map Origin Row: 4499.5
"""),
    "universal_transverse_mercator_e01": ("gpd", """\
Map Projection: Universal Transverse Mercator
Map Equatorial Radius: 6378206.4
Map Polar Radius: 6356583.8
Map Reference Longitude: 75.0
Map Reference Latitude: -40.0
Map Maximum Error: 0.0
Map Southern Bound: -50.0
Map Northern Bound: -30.0
Map Western Bound: 60.0
Map Eastern Bound: 90.0
Grid Width: 300
Grid Height: 300
Grid Map Units per Cell: 1000
Grid Map Origin Column: 149.5
Grid Map Origin Row: -4199.5
"""),
}

#: Definition, direction (xy: latitude and longitude to map x and y; cr: to grid column and row), input, output.
POINTS = [
    ("M200correct", "xy forward", (75.0, -150.0), (-72.0312517, 35.4351968)),
    ("M200correct", "xy inverse", (-72.0312517, 35.4351968), (74.9999997, -150.0)),
    ("M200correct", "xy forward", (-75.0, 150.0), (72.0312517, -35.4351968)),
    ("M200correct", "xy inverse", (72.0312517, -35.4351968), (-74.9999997, 150.0)),
    ("Ml", "cr forward", (75.0, -150.0), (114.7499865, 9.0184252)),
    ("Ml", "cr inverse", (114.7499865, 9.0184252), (75.0, -150.0)),
    ("Ml", "cr forward", (-75.0, 150.0), (1267.2500135, 575.9815748)),
    ("Ml", "cr inverse", (1267.2500135, 575.9815748), (-75.0, 150.0)),
    ("N200correct", "xy forward", (75.0, -150.0), (-4.14686, 7.1825722)),
    ("N200correct", "xy inverse", (-4.14686, 7.1825722), (75.0, -150.0)),
    ("N3B", "cr forward", (75.0, -150.0), (90.3704126, 216.584478)),
    ("N3B", "cr inverse", (90.3704126, 216.584478), (75.0, -150.0)),
    ("Na25", "cr forward", (75.0, -150.0), (146.8251201, 122.5394225)),
    ("Na25", "cr inverse", (146.8251201, 122.5394225), (75.0, -150.0)),
    ("Nps", "xy forward", (75.0, -150.0), (-15.7823969, 4.2288805)),
    ("Nps", "xy inverse", (-15.7823969, 4.2288805), (75.0, -150.0)),
    ("S200correct", "xy forward", (-75.0, 150.0), (4.14686, -7.1825722)),
    ("S200correct", "xy inverse", (4.14686, -7.1825722), (-75.0, 150.0)),
    ("S3B", "cr forward", (-75.0, 150.0), (190.1782791, 230.1004397)),
    ("S3B", "cr inverse", (190.1782791, 230.1004397), (-75.0, 150.0)),
    ("Sa25", "cr forward", (-75.0, 150.0), (193.1748799, 217.4605775)),
    ("Sa25", "cr inverse", (193.1748799, 217.4605775), (-75.0, 150.0)),
    ("Sps", "xy forward", (-75.0, 150.0), (8.1695698, -14.1501099)),
    ("Sps", "xy inverse", (8.1695698, -14.1501099), (-75.0, 149.9999999)),
    ("albers_conic_equal_area_e00", "xy forward", (35.0, -75.0), (1885472.728229, 1535924.9987983)),
    ("albers_conic_equal_area_e00", "xy inverse", (1885472.7, 1535925.0), (35.0000001, -75.0000003)),
    ("albers_conic_equal_area_e00", "cr forward", (35.0, -75.0), (275.1981819, 47.1050001)),
    ("albers_conic_equal_area_e00", "cr inverse", (275.1981819, 47.1050001), (35.0, -75.0)),
    ("albers_conic_equal_area_e01", "xy forward", (-35.0, 75.0), (-1885472.728229, -1535924.9987983)),
    ("albers_conic_equal_area_e01", "xy inverse", (-1885472.7, -1535925.0), (-35.0000001, 75.0000003)),
    ("albers_conic_equal_area_e01", "cr forward", (-35.0, 75.0), (23.8018181, 251.8949999)),
    ("albers_conic_equal_area_e01", "cr inverse", (23.8018181, 251.8949999), (-35.0, 75.0)),
    ("albers_conic_equal_area_s00", "xy forward", (35.0, -75.0), (0.295272, 0.2416774)),
    ("albers_conic_equal_area_s00", "xy inverse", (0.295272, 0.2416774), (34.9999974, -75.0000012)),
    ("albers_conic_equal_area_s00", "cr forward", (35.0, -75.0), (297.1360035, 28.6612754)),
    ("albers_conic_equal_area_s00", "cr inverse", (297.1360035, 28.6612754), (35.0, -75.0)),
    ("albers_conic_equal_area_s01", "xy forward", (-35.0, 75.0), (-0.295272, -0.2416774)),
    ("albers_conic_equal_area_s01", "xy inverse", (-0.295272, -0.2416774), (-34.9999974, 75.0000012)),
    ("albers_conic_equal_area_s01", "cr forward", (-35.0, 75.0), (1.8639965, 270.3387246)),
    ("albers_conic_equal_area_s01", "cr inverse", (1.8639965, 270.3387246), (-35.0, 75.0)),
    ("azimuthal_equal_area_e00", "xy forward", (30.0, -110.0), (-965932.111124, -1056814.9225207)),
    ("azimuthal_equal_area_e00", "xy inverse", (-965932.1, -1056814.9), (30.0000002, -109.9999999)),
    ("azimuthal_equal_area_e00", "cr forward", (30.0, -110.0), (85.1045259, 219.9543282)),
    ("azimuthal_equal_area_e00", "cr inverse", (85.1045259, 219.9543282), (30.0, -110.0)),
    ("azimuthal_equal_area_e01", "xy forward", (80.0, 5.0), (1077459.6859076, 288704.452716)),
    ("azimuthal_equal_area_e01", "xy inverse", (1077459.7, 288704.5), (79.9999998, 5.0000022)),
    ("azimuthal_equal_area_e01", "cr forward", (80.0, 5.0), (221.3306457, 130.2530365)),
    ("azimuthal_equal_area_e01", "cr inverse", (221.3306457, 130.2530365), (80.0, 5.0)),
    ("azimuthal_equal_area_e02", "xy forward", (-30.0, 110.0), (965932.111124, 1056814.9225207)),
    ("azimuthal_equal_area_e02", "xy inverse", (965932.1, 1056814.9), (-30.0000002, 109.9999999)),
    ("azimuthal_equal_area_e02", "cr forward", (-30.0, 110.0), (213.8954741, 79.0456718)),
    ("azimuthal_equal_area_e02", "cr inverse", (213.8954741, 79.0456718), (-30.0, 110.0)),
    ("azimuthal_equal_area_e03", "xy forward", (-80.0, -5.0), (-1077459.6859076, -288704.452716)),
    ("azimuthal_equal_area_e03", "xy inverse", (-1077459.7, -288704.5), (-79.9999998, -5.0000022)),
    ("azimuthal_equal_area_e03", "cr forward", (-80.0, -5.0), (77.6693543, 168.7469635)),
    ("azimuthal_equal_area_e03", "cr inverse", (77.6693543, 168.7469635), (-80.0, -5.0)),
    ("azimuthal_equal_area_s00", "xy forward", (-20.0, 100.0), (-4.2339303, 4.0257775)),
    ("azimuthal_equal_area_s00", "xy inverse", (-4.2339303, 4.0257775), (-19.9999993, 100.0000004)),
    ("azimuthal_equal_area_s00", "cr forward", (-20.0, 100.0), (3.1248776, 17.6955755)),
    ("azimuthal_equal_area_s00", "cr inverse", (3.1248776, 17.6955755), (-20.0, 100.0)),
    ("cylindrical_equal_area_e00", "xy forward", (5.0, -78.0), (-332699.8326094, 554248.44746)),
    ("cylindrical_equal_area_e00", "xy inverse", (-332699.8, 554248.5), (5.0000005, -77.9999997)),
    ("cylindrical_equal_area_e00", "cr forward", (5.0, -78.0), (127.3200112, 112.5501035)),
    ("cylindrical_equal_area_e00", "cr inverse", (127.3200112, 112.5501035), (5.0, -78.0)),
    ("cylindrical_equal_area_s00", "xy forward", (35.0, 80.0), (2.3428242, 0.662309)),
    ("cylindrical_equal_area_s00", "xy inverse", (2.3428242, 0.662309), (34.9999988, 80.0000014)),
    ("cylindrical_equal_area_s00", "cr forward", (35.0, 80.0), (483.7824179, 33.269098)),
    ("cylindrical_equal_area_s00", "cr inverse", (483.7824179, 33.269098), (35.0, 80.0)),
    ("cylindrical_equidistant_s00", "xy forward", (-50.0, -75.0), (-75.0, -50.0)),
    ("cylindrical_equidistant_s00", "xy inverse", (-75.0, -50.0), (-50.0, -75.0)),
    ("cylindrical_equidistant_s00", "cr forward", (-50.0, -75.0), (104.5, 139.5)),
    ("cylindrical_equidistant_s00", "cr inverse", (104.5, 139.5), (-50.0, -75.0)),
    ("homolosine_s00", "xy forward", (40.0, -105.0), (-11545388.5062071, 4447794.9713872)),
    ("homolosine_s00", "xy inverse", (-11545388.51, 4447794.97), (40.0, -105.0)),
    ("homolosine_s00", "cr forward", (40.0, -105.0), (290.4222988, 109.9410057)),
    ("homolosine_s00", "cr inverse", (290.4222988, 109.9410057), (40.0, -105.0)),
    ("integerized_sinusoidal_s00", "xy forward", (-50.0, -70.0), (-5003230.3725478, -5559752.5988326)),
    ("integerized_sinusoidal_s00", "xy inverse", (-5003230.37, -5559752.6), (-50.0, -70.0)),
    ("integerized_sinusoidal_s00", "cr forward", (40.0, -105.0), (210.6920717, 109.9395842)),
    ("integerized_sinusoidal_s00", "cr inverse", (210.6920717, 109.9395842), (40.0, -105.0)),
    ("lambert_conic_conformal_e00", "xy forward", (35.0, -75.0), (1894410.9007363, 1564649.4720957)),
    ("lambert_conic_conformal_e00", "xy inverse", (1894410.9, 1564649.5), (35.0000002, -74.9999999)),
    ("lambert_conic_conformal_e00", "cr forward", (35.0, -75.0), (275.79406, 45.1900352)),
    ("lambert_conic_conformal_e00", "cr inverse", (275.79406, 45.1900352), (35.0, -75.0)),
    ("lambert_conic_conformal_e01", "xy forward", (-35.0, 75.0), (-1894410.9007363, -1564649.4720957)),
    ("lambert_conic_conformal_e01", "xy inverse", (-1894410.9, -1564649.5), (-35.0000002, 74.9999999)),
    ("lambert_conic_conformal_e01", "cr forward", (-35.0, 75.0), (23.20594, 253.8099648)),
    ("lambert_conic_conformal_e01", "cr inverse", (23.20594, 253.8099648), (-35.0, 75.0)),
    ("mercator_s00", "xy forward", (35.0, -75.0), (1.8325957, 0.6528366)),
    ("mercator_s00", "xy inverse", (1.8325957, 0.6528366), (35.000001, -75.0000008)),
    ("mercator_s00", "cr forward", (35.0, -75.0), (432.7595715, 34.216342)),
    ("mercator_s00", "cr inverse", (432.7595715, 34.216342), (35.0, -75.0)),
    ("mollweide_s00", "xy forward", (-50.0, -75.0), (0.1788845, -0.9208758)),
    ("mollweide_s00", "xy inverse", (0.1788845, -0.9208758), (-50.0000005, -74.999999)),
    ("mollweide_s00", "cr forward", (-50.0, -75.0), (271.8605612, 194.6094739)),
    ("mollweide_s00", "cr inverse", (271.8605612, 194.6094739), (-50.0, -75.0)),
    ("orthographic_s00", "xy forward", (30.0, -110.0), (-0.1503837, -0.1651911)),
    ("orthographic_s00", "xy inverse", (-0.1503837, -0.1651911), (30.0000004, -109.9999978)),
    ("orthographic_s00", "cr forward", (30.0, -110.0), (74.3081334, 232.0955517)),
    ("orthographic_s00", "cr inverse", (74.3081334, 232.0955517), (30.0, -110.0)),
    ("polar_stereographic_e00", "xy forward", (-75.0, 150.0), (-1540033.611719, -560526.3944352)),
    ("polar_stereographic_e00", "xy inverse", (-1540033.6, -560526.4), (-75.0000001, 149.9999997)),
    ("polar_stereographic_e00", "cr forward", (-75.0, 150.0), (46.8310926, 186.8684263)),
    ("polar_stereographic_e00", "cr inverse", (46.8310926, 186.8684263), (-75.0, 150.0)),
    ("polar_stereographic_e01", "xy forward", (75.0, -150.0), (1540033.611719, 560526.3944352)),
    ("polar_stereographic_e01", "xy inverse", (1540033.6, 560526.4), (75.0000001, -149.9999997)),
    ("polar_stereographic_e01", "cr forward", (75.0, -150.0), (252.1689074, 112.1315737)),
    ("polar_stereographic_e01", "cr inverse", (252.1689074, 112.1315737), (75.0, -150.0)),
    ("polar_stereographic_s00", "xy forward", (-75.0, 150.0), (-0.2406857, -0.0876024)),
    ("polar_stereographic_s00", "xy inverse", (-0.2406857, -0.0876024), (-75.000001, 150.0000064)),
    ("polar_stereographic_s00", "cr forward", (-75.0, 150.0), (29.1571465, 193.3012166)),
    ("polar_stereographic_s00", "cr inverse", (29.1571465, 193.3012166), (-75.0, 150.0)),
    ("polar_stereographic_s01", "xy forward", (75.0, -150.0), (0.2406857, 0.0876024)),
    ("polar_stereographic_s01", "xy inverse", (0.2406857, 0.0876024), (75.000001, -150.0000064)),
    ("polar_stereographic_s01", "cr forward", (75.0, -150.0), (269.8428535, 105.6987834)),
    ("polar_stereographic_s01", "cr inverse", (269.8428535, 105.6987834), (75.0, -150.0)),
    ("sinusoidal_s00", "xy forward", (-50.0, -75.0), (0.1682814, -0.8726646)),
    ("sinusoidal_s00", "xy inverse", (0.1682814, -0.8726646), (-49.9999985, -75.0000007)),
    ("sinusoidal_s00", "cr forward", (-50.0, -75.0), (272.2179894, 242.3097245)),
    ("sinusoidal_s00", "cr inverse", (272.2179894, 242.3097245), (-50.0, -75.0)),
    ("sinusoidal_s01", "xy forward", (50.0, 75.0), (-0.1682814, 0.8726646)),
    ("sinusoidal_s01", "xy inverse", (-0.1682814, 0.8726646), (49.9999985, 75.0000007)),
    ("sinusoidal_s01", "cr forward", (50.0, 75.0), (226.7820106, 6.6902755)),
    ("sinusoidal_s01", "cr inverse", (226.7820106, 6.6902755), (50.0, 75.0)),
    ("transverse_mercator_e00", "xy forward", (40.5, -73.5), (127106.467448, 4484124.4561541)),
    ("transverse_mercator_e00", "xy inverse", (127106.5, 4484124.4), (40.5000003, -73.4999996)),
    ("transverse_mercator_e00", "cr forward", (40.5, -73.5), (276.6064674, 15.3755438)),
    ("transverse_mercator_e00", "cr inverse", (276.6064674, 15.3755438), (40.5000008, -73.5)),
    ("transverse_mercator_e01", "xy forward", (-40.5, 73.5), (-127106.4673941, -4484124.4631579)),
    ("transverse_mercator_e01", "xy inverse", (-127106.5, -4484124.4), (-40.5000003, 73.4999996)),
    ("transverse_mercator_e01", "cr forward", (-40.5, 73.5), (22.3935326, 284.6244632)),
    ("transverse_mercator_e01", "cr inverse", (22.3935326, 284.6244632), (-40.5000008, 73.5)),
    ("transverse_mercator_s00", "xy forward", (40.5, -73.5), (0.0199077, 0.7070276)),
    ("transverse_mercator_s00", "xy inverse", (0.0199077, 0.7070276), (40.4999995, -73.5000028)),
    ("transverse_mercator_s00", "cr forward", (40.5, -73.5), (150.6944642, 107.0783435)),
    ("transverse_mercator_s00", "cr inverse", (150.6944642, 107.0783435), (40.5, -73.5)),
    ("universal_transverse_mercator_e00", "xy forward", (40.5, -73.5), (627106.467448, 4484124.4561541)),
    ("universal_transverse_mercator_e00", "xy inverse", (627106.5, 4484124.4), (40.5000003, -73.4999996)),
    ("universal_transverse_mercator_e00", "cr forward", (40.5, -73.5), (276.6064674, 15.3755438)),
    ("universal_transverse_mercator_e00", "cr inverse", (276.6064674, 15.3755438), (40.5000008, -73.5)),
    ("universal_transverse_mercator_e01", "xy forward", (-40.5, 73.5), (372893.5326059, 5515875.5368421)),
    ("universal_transverse_mercator_e01", "xy inverse", (372893.5, 5515875.6), (-40.5000003, 73.4999996)),
    ("universal_transverse_mercator_e01", "cr forward", (-40.5, 73.5), (22.3935326, 284.6244632)),
    ("universal_transverse_mercator_e01", "cr inverse", (22.3935326, 284.6244632), (-40.5000008, 73.5)),
]
