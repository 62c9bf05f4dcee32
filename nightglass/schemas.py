"""Schemas of the data model, as DDL."""

from __future__ import annotations

CARD = "struct<hdu_index:int,card_index:int,keyword:string,value:string,comment:string,raw_card:string>"
CARDS = f"array<{CARD}>"

EQUIPMENT = "struct<telescope_name:string,focal_length:float,aperture:float,focal_ratio:float,reducer_flattener:string,mount_model:string,focuser_position:int,focuser_temperature:float>"
DETECTOR = "struct<camera_name:string,pixel_size:float,width:bigint,height:bigint,binning_x:bigint,binning_y:bigint,gain:float,offset:int,readout_mode:string,usb_limit:string,read_noise:float,full_well:float,temperature:float,temp_setpoint:float,cooler_power:float,cooler_status:string,rotator_angle:float>"
FILTER = "struct<name:string,position:bigint,wavelength:float>"
EXPOSURE = "struct<object_name:string,ra:double,dec:double,date_obs:timestamp,session_date:timestamp,exposure_time:float,frame_type:string,sequence_id:string,frame_number:bigint,dither_offset_x:float,dither_offset_y:float,project_name:string,session_id:string>"
MOUNT = "struct<pier_side:string,meridian_flip:boolean,latitude:double,longitude:double,height:double,guide_camera:string,guide_rms:float,guide_scale:float,dither_enabled:boolean,peak_ra_error:float,peak_dec_error:float>"
ENVIRONMENT = "struct<ambient_temp:float,humidity:float,dew_heater_power:float,voltage:float,current:float,software_version:string,plugin_info:string,sqm:float>"
WCS = "struct<ctype1:string,ctype2:string,crpix1:double,crpix2:double,crval1:double,crval2:double,cd1_1:double,cd1_2:double,cd2_1:double,cd2_2:double,crota2:double,airmass:float,altitude:float,azimuth:float>"
XISF = "struct<version:string,creator:string,creation_time:timestamp,block_alignment:bigint>"
COLOR = "struct<color_space:string,icc_profile:binary,display_function:struct<function_type:string,parameters:map<string,double>>>"
ATTACHMENTS = "array<struct<id:string,geometry:string,sample_format:string,bits_per_sample:bigint,compression:string,compression_parameters:map<string,string>,checksum_type:string,checksum:string,resolution_x:double,resolution_y:double,resolution_unit:string>>"

METADATA = {
    "equipment": EQUIPMENT, "detector": DETECTOR, "filter": FILTER, "exposure": EXPOSURE, "mount": MOUNT, "environment": ENVIRONMENT,
    "wcs": WCS, "xisf": XISF, "color_management": COLOR, "attachments": ATTACHMENTS,
}

SCAN = f"path string, format string, status string, error string, shape array<int>, cards {CARDS}, xml string"
IMAGE = "path string, width int, height int, pixels array<float>, status string, error string"
STARS = "frame_id string, star_idx int, x double, y double, flux float, peak float, a float, b float, theta float, eccentricity float, fwhm float, kron_radius float, flux_auto float, fluxerr_auto float, npix int, elongation float, flag int"
STAR_LIST = f"array<struct<{','.join(':'.join(c.split()) for c in STARS.split(', ')[1:])}>>"
BACKGROUND = "struct<median:float,rms:float,min:float,max:float,uniformity:float>"
DETECTED = f"path string, frame_id string, status string, background {BACKGROUND}, stars {STAR_LIST}"
FRAME = f"{SCAN}, image_status string, image_error string, width int, height int, pixel_stats struct<min:double,max:double,mean:double>, nonfinite boolean, background {BACKGROUND}, stars {STAR_LIST}, header_seconds double, load_seconds double, detect_seconds double"
